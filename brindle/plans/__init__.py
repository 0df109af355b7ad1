"""The registered queries. Importing the package registers them all."""

from importlib import import_module

for _part in ("exploring", "primitives", "baskets", "similarity", "recommending", "graphs", "sketching", "streams", "clusters", "predicting", "saving"):
    import_module(f"brindle.plans.{_part}")
