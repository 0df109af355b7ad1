"""Licence scans by Dice coefficient over word bigrams.

A text's units are the whole text and, where it has more than one line, each line and each run of
lines. A unit's words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z became a-z; its bigrams are the distinct pairs of
neighbouring words. Dice is twice the shared bigrams over the sum of both counts. For a threshold t
only templates whose count is between t/(2-t) and (2-t)/t of the unit's can reach it, and a unit
must share at least t/(2-t) of the template's. A unit with fewer bigrams than a template's lower bound
is not compared with it at all; of the others the shared bigrams are counted, and a unit's own distinct
ones only if it shares enough, which the upper bound then prunes.

A unit's licence is that of its best template (ties: the first name); it counts from the threshold
on. Whole texts and lines count whatever else matches. Runs find notices wrapped over several lines
of a longer text; of runs that overlap, the one of the highest Dice counts (then the shortest, then
the first), and none does where the whole text matches the same licence, or where the whole text or
a line of the run matches at least as well. Only texts that hold enough of a template's bigrams have
their runs looked at: from each line with such a bigram on, as far as the size bounds allow. Null and empty texts, and units of one word, match nothing. Repeated rows each give theirs.
"""

from __future__ import annotations

from bisect import bisect, insort
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import bytewords
from brindle.llm.common import documents, with_row_id
from brindle.llm.license_full import FULL
from brindle.llm.license_texts import TEMPLATES as NOTICES

TEMPLATES = NOTICES + FULL

THRESHOLD = 0.8

_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


def _bigrams(hashes: np.ndarray) -> np.ndarray:
    return bytewords.mix(hashes[:-1] * _SECOND + hashes[1:])


class Templates:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> None:
        self.threshold = threshold
        order = sorted(range(len(templates)), key=lambda i: templates[i][0])
        self.names = [templates[i][0] for i in order]
        sets = []
        for i in order:
            raw = np.frombuffer(templates[i][1].encode(), np.uint8)
            hashes = np.concatenate([w.hash for w in bytewords.words(raw, np.array([0, len(raw)]), bytewords.ALNUM)])
            sets.append(np.unique(_bigrams(hashes)))
        self.sizes = np.array([len(s) for s in sets])
        self.known = np.unique(np.concatenate(sets))
        pairs = np.array([(b, t) for t, s in enumerate(sets) for b in np.searchsorted(self.known, s).tolist()])
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        self.of = pairs[:, 1]
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(self.known) + 1))
        # shared bigrams that a unit needs at least, whatever its own count; and of its own at most
        self.least = np.ceil(self.sizes * threshold / (2 - threshold) - 1e-9)
        self.most = np.floor(self.sizes * (2 - threshold) / threshold + 1e-9)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.known >> np.uint64(48)).astype(np.int64)] = True

    def lookup(self, bigrams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, number) of those that some template has."""
        at = np.flatnonzero(self.maybe[(bigrams >> np.uint64(48)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.known, bigrams[at]), len(self.known) - 1)
        hit = self.known[k] == bigrams[at]
        return at[hit], k[hit]

    def within_reach(self, unit: np.ndarray, bigrams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, template, shared bigrams) where a unit, of which `unit` has ascending numbers, shares as
        many as the template asks for. Units with fewer bigrams than the smallest template asks for,
        and templates that ask for more than the unit has, drop out before anything is counted."""
        none = np.empty(0, np.int64)
        if not len(unit):
            return none, none, none
        edge = np.flatnonzero(np.diff(unit, prepend=unit[0] - 1))
        room = np.diff(edge, append=len(unit))
        room = np.repeat(room, room)
        large = np.flatnonzero(room >= self.least.min())
        at, number = self.lookup(bigrams[large])
        at = large[at]
        per = self.first[number + 1] - self.first[number]
        where = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per - self.first[number], per)
        template = self.of[where]
        fits = self.least[template] <= np.repeat(room[at], per)
        place, template, number = np.repeat(at, per)[fits], template[fits], np.repeat(number, per)[fits]
        seen = np.unique((unit[place] * len(self.names) + template) * len(self.known) + number)
        key, shared = np.unique(seen // len(self.known), return_counts=True)
        u, t = key // len(self.names), key % len(self.names)
        keep = shared >= self.least[t]
        return u[keep], t[keep], shared[keep]

    def match(self, unit: np.ndarray, bigrams: np.ndarray) -> list[tuple[int, int, float]]:
        """(unit, template, Dice) of each unit that reaches the threshold. `unit` ascends."""
        u, t, shared = self.within_reach(unit, bigrams)
        best: dict[int, tuple[float, int]] = {}
        size_of: dict[int, int] = {}
        for i, j, n in zip(u.tolist(), t.tolist(), shared.tolist()):
            if i not in size_of:
                a, b = np.searchsorted(unit, (i, i + 1))
                size_of[i] = len(np.unique(bigrams[a:b]))
            if not self.least[j] <= size_of[i] <= self.most[j]:
                continue
            dice = 2 * n / (size_of[i] + int(self.sizes[j]))
            if dice >= self.threshold and (i not in best or dice > best[i][0]):
                best[i] = (dice, j)
        return [(i, j, d) for i, (d, j) in sorted(best.items())]

    def runs(self, bigrams: np.ndarray, first: np.ndarray, second: np.ndarray, among: list[int]) -> list[tuple[int, int, int, float]]:
        """(first line, last line, template, Dice) of runs of two lines or more that don't overlap, for
        one document's bigrams in order, the lines of their two words, and the templates in reach. A
        run begins and ends with a line that has bigrams of its template; others only lower Dice."""
        at, number = self.lookup(bigrams)
        asked = set(among)
        has = {n: [t for t in self.of[self.first[n] : self.first[n + 1]].tolist() if t in asked] for n in set(number.tolist())}
        hits = {int(self.known[n]): ts for n, ts in has.items() if ts}
        grams, first, second = bigrams.tolist(), first.tolist(), second.tolist()
        starts = {first[i] for i, n in zip(at.tolist(), number.tolist()) if has[n]}
        size = {t: int(self.sizes[t]) for t in among}
        most = max(size.values()) * (2 - self.threshold) / self.threshold + 1e-9
        # distinct bigrams from here on, the nearest last, with the lines of their words
        ahead: OrderedDict[int, tuple[int, int]] = OrderedDict()
        found: list[tuple[float, int, int, int]] = []
        for i in range(len(grams) - 1, -1, -1):
            ahead[grams[i]] = first[i], second[i]
            ahead.move_to_end(grams[i])
            a = first[i]
            if a not in starts or (i and first[i - 1] == a):
                continue
            n, end, shared, fresh, begun = 0, a, dict.fromkeys(among, 0), set(), set()

            def close() -> None:
                if end > a:
                    dice = {t: 2 * shared[t] / (n + size[t]) for t in fresh & begun}
                    found.extend((-d, end - a, a, t) for t, d in dice.items() if d >= self.threshold)

            for gram, (begins, line) in reversed(ahead.items()):
                if line != end:
                    close()
                    end = line
                    fresh = set()
                n += 1
                if n > most:
                    break
                for t in hits.get(gram, ()):
                    shared[t] += 1
                    fresh.add(t)
                    if begins == a:
                        begun.add(t)
            else:
                close()
        taken: list[tuple[int, int, int, float]] = []
        for d, more, a, t in sorted(found):
            k = bisect(taken, (a, a + more, len(self.names), 0.0))
            if (not k or taken[k - 1][1] < a) and (k == len(taken) or taken[k][0] > a + more):
                insort(taken, (a, a + more, t, -d))
        return taken


def _scan(templates: Templates, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("line", pa.int64()), ("last", pa.int64()), ("license", pa.string()), ("dice", pa.float64())]))
    for batch in batches:
        data, offsets = bytewords.text_buffers(batch.column(2))
        found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        for w in bytewords.words(data, offsets, bytewords.ALNUM):
            if len(w.hash) < 2:
                continue
            doc = np.repeat(np.arange(w.hi - w.lo), np.diff(w.bounds))
            breaks = np.cumsum(w.data == 10)
            line = breaks[w.start]
            bigrams = _bigrams(w.hash)
            inside = doc[1:] == doc[:-1]
            for whole in (True, False):
                if whole:
                    unit, ok = doc, inside
                else:
                    # no line has a break in it, so breaks before it tell lines of a block apart
                    unit, ok = line + doc, inside & (line[1:] == line[:-1])
                for u, t, dice in templates.match(unit[1:][ok], bigrams[ok]):
                    if whole:
                        d, number = u, 0
                    else:
                        first = int(np.searchsorted(unit, u))
                        d = int(doc[first])
                        a, b = w.offsets[d], w.offsets[d + 1]
                        before = int(breaks[a - 1]) if a else 0
                        if b == a or int(breaks[b - 1]) == before:
                            continue  # the only line is the whole text
                        number = int(line[first]) - before + 1
                    found[w.lo + d].append({"line": number, "last": number, "license": templates.names[t], "dice": dice})
            among: dict[int, list[int]] = {}
            for d, t in zip(*(x.tolist() for x in templates.within_reach(doc[1:][inside], bigrams[inside])[:2])):
                among.setdefault(d, []).append(t)
            for d, near in among.items():
                i, j = int(w.bounds[d]), int(w.bounds[d + 1]) - 1
                if line[i] == line[j]:
                    continue
                mine = found[w.lo + d]
                of_text, of_line = [m for m in mine if not m["line"]], [m for m in mine if m["line"]]
                before = int(breaks[w.offsets[d] - 1]) if w.offsets[d] else 0
                for a, b, t, dice in templates.runs(bigrams[i:j], line[i:j] - before + 1, line[i + 1 : j + 1] - before + 1, near):
                    name = templates.names[t]
                    if not any(m["license"] == name or m["dice"] >= dice for m in of_text) and not any(a <= m["line"] <= b and m["dice"] >= dice for m in of_line):
                        mine.append({"line": a, "last": b, "license": name, "dice": dice})
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], ["row_id", "id", "matches"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `docs`: row_id, its id and matches (line and last, the unit's first and
    last line from 1, both 0 for the whole text; license; dice), empty where there are none."""
    kind = dict(docs.dtypes)[id_col]
    known = Templates(templates, threshold)
    rows = with_row_id(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select("row_id", "id", "text")
    schema = f"row_id long, id {kind}, matches array<struct<line:long,last:long,license:string,dice:double>>"
    return rows.mapInArrow(lambda batches: _scan(known, batches), schema).withColumnRenamed("id", id_col)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan(documents(spark, sf_dir))
    best = F.array_sort("matches", lambda a, b: F.when(a.dice > b.dice, -1).when(a.dice < b.dice, 1).when(a.license < b.license, -1).when(a.license > b.license, 1).otherwise(0))
    return got.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct("matches.license")), ",").alias("licenses"),
        F.try_element_at(best, F.lit(1)).getField("license").alias("best_license"),
        F.round(F.try_element_at(best, F.lit(1)).getField("dice"), 6).alias("best_dice"),
    )


def oracle() -> str:
    quoted = ", ".join("('{}', {}, '{}')".format(name, i, " ".join(text.split()).replace("'", "''")) for i, (name, text) in enumerate(sorted(TEMPLATES, key=lambda t: t[0])))
    words = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
        WITH t AS (SELECT name, no, {words.format("body")} AS w FROM (VALUES {quoted}) AS v(name, no, body)),
        tb AS (SELECT name, no, {pairs} AS b FROM t),
        te AS (SELECT name, no, len(b) AS m, unnest(b) AS bigram FROM tb),
        u AS (
            SELECT doc_id, 0 AS line, text AS body FROM documents WHERE text IS NOT NULL
            UNION ALL
            SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)), unnest(string_split(text, chr(10)))
            FROM documents WHERE contains(text, chr(10))),
        uw AS (SELECT doc_id, line, {words.format("body")} AS w FROM u),
        ub AS (SELECT doc_id, line, {pairs} AS b FROM uw WHERE len(w) > 1),
        ue AS (SELECT doc_id, line, len(b) AS n, unnest(b) AS bigram FROM ub),
        d AS (
            SELECT doc_id, line, name, no, 2 * count(*) / (any_value(n) + any_value(m)) AS dice
            FROM ue JOIN te USING (bigram) GROUP BY doc_id, line, name, no),
        best AS (
            SELECT doc_id, line, name, dice, row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, no) AS rn
            FROM d WHERE dice >= {THRESHOLD}),
        r AS (
            SELECT doc_id, count(*) AS n_matches, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses,
                   first(name ORDER BY dice DESC, name) AS best_license, max(dice) AS best_dice
            FROM best WHERE rn = 1 GROUP BY doc_id)
        SELECT doc_id, coalesce(n_matches, 0) AS n_matches, coalesce(licenses, '') AS licenses, best_license, round(best_dice, 6) AS best_dice
        FROM documents LEFT JOIN r USING (doc_id)"""
