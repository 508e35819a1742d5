"""Divergence between the sources of a language over run-length encoded count columns.

1. Tasks count terms per (language, source) in memory of bounded size and hand on pre-aggregated rows; one
   shuffle by (language, term) adds them up and keeps the terms in enough documents.
2. The vocabulary of a language is reordered by its terms' counts in all sources, so that equal counts stand
   together, and cut into blocks along that order. In a block each source is a column of counts, held as runs.
   Of the runs only their ends and counts are kept; a source that lacks all of a block's terms is one run.
3. A pair of sources meets block by block: the ends of both columns' runs are merged, and f of the two counts
   is taken once per merged run and multiplied by its length. Blocks are independent, so a language that holds
   most of the corpus is spread over all tasks. Tasks add up their blocks before the sums are shuffled.
4. A block also yields the terms that set a source apart from its whole language, at most ``top`` a source.

All arithmetic is exact: p = 1 + floor(10^9 (count + 2) / (N + 2 V)) is taken by long division in steps
of 10^3, which hold counts up to 10^15.

Edge cases: null text, language and source count as empty. A group without terms has zero counts; a language
without kept terms gives pairs of value 0 and no terms. One source alone has no pairs. Repeated rows count
each time. An empty table gives an empty result. Other columns do not matter.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowloom.llm.bytewords import text_buffers
from flowloom.llm.common import arrow_map, text_of
from flowloom.session import stored

ONE = 10**9
MIN_DOCUMENTS = 10
TOP = 10
BLOCK_TERMS = 1 << 14
#: Distinct (language, source, term) entries a task holds before it hands them on.
HELD_ENTRIES = 1 << 18
#: Languages are dealt to blocks through so many copies of a language's row.
SALT = 32

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _counts(batches):
    """(lang, source, term) with occurrences and documents, added up in memory."""
    import pyarrow as pa

    def rows():
        keys = [(g, t) for g, held in uses.items() for t in held]
        return pa.RecordBatch.from_arrays(
            [pa.array([g[0] for g, _ in keys], pa.string()), pa.array([g[1] for g, _ in keys], pa.string()),
             pa.array([t for _, t in keys], pa.binary()).cast(pa.string()),
             pa.array([uses[g][t] for g, t in keys], pa.int64()), pa.array([docs[g][t] for g, t in keys], pa.int64())],
            names=["lang", "source", "term", "n", "docs"])

    uses, docs, seen = defaultdict(Counter), defaultdict(Counter), 0
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        groups = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()))
        for i, group in enumerate(groups):
            words = data[offsets[i]:offsets[i + 1]].tobytes().translate(_LETTERS).split()
            if not words:
                continue
            own, before = uses[group], len(uses[group])
            own.update(words)
            docs[group].update(set(words))
            seen += len(own) - before
            if seen >= HELD_ENTRIES:
                yield rows()
                uses, docs, seen = defaultdict(Counter), defaultdict(Counter), 0
    if seen:
        yield rows()


def term_counts(documents: DataFrame) -> DataFrame:
    """Occurrences and documents of every term per language and source; rows still to be added up."""
    read = documents.select(text_of("lang").alias("lang"), text_of("source").alias("source"), text_of("text").alias("text"))
    return arrow_map(read, _counts, "lang string, source string, term string, n bigint, docs bigint")


def vocabulary(documents: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """The kept terms of each language with their counts by source, sources in order."""
    # one shuffle serves both aggregations: the second one's keys are among the first one's
    counted = term_counts(documents).repartition("lang", "term").groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return (counted.groupBy("lang", "term")
            .agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("cells"))
            .where(F.col("docs") >= min_documents).drop("docs"))


def _blocks(batches):
    """Runs of every source's counts over blocks of the ordered vocabulary."""
    import pyarrow as pa

    names = ["lang", "size", "terms", "sources", "ends", "counts"]
    schema = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("terms", pa.list_(pa.string())), ("sources", pa.list_(pa.string())),
                        ("ends", pa.list_(pa.list_(pa.int32()))), ("counts", pa.list_(pa.list_(pa.int64())))])

    def block(lang, terms, cells):
        columns: dict[str, np.ndarray] = {}
        for place, row in enumerate(cells):
            for cell in row:
                if (column := columns.get(cell["source"])) is None:
                    column = columns[cell["source"]] = np.zeros(len(terms), np.int64)
                column[place] = cell["n"]
        sources = sorted(columns)
        runs = [_runs(columns[s]) for s in sources]
        values = [lang, len(terms), terms, sources, [e.tolist() for e, _ in runs], [c.tolist() for _, c in runs]]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], names=names)

    lang, terms, cells = None, [], []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("lang", "term", "cells"))):
            if terms and (row[0] != lang or len(terms) >= BLOCK_TERMS):
                yield block(lang, terms, cells)
                terms, cells = [], []
            lang = row[0]
            terms.append(row[1])
            cells.append(row[2])
    if terms:
        yield block(lang, terms, cells)


def _runs(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends (exclusive) and values of a column's runs."""
    ends = np.append(np.flatnonzero(column[1:] != column[:-1]) + 1, len(column))
    return ends, column[ends - 1]


BLOCKS = "lang string, size int, terms array<string>, sources array<string>, ends array<array<int>>, counts array<array<bigint>>"


def run_length_blocks(words: DataFrame) -> DataFrame:
    """The vocabulary in the order of its counts, as run-length encoded columns; the term itself breaks ties and splits equal keys."""
    ordered = words.repartitionByRange("lang", "cells", "term").sortWithinPartitions("lang", "cells", "term")
    return arrow_map(ordered, _blocks, BLOCKS)


def shares(counts: np.ndarray, total: int, size: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 size)), by long division, three digits a step."""
    divisor = np.int64(total + 2 * size)
    whole, rest = np.divmod(np.asarray(counts, np.int64) + 2, divisor)
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, divisor)
        whole = whole * 1000 + step
    return whole + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _pair_value(a, b) -> int:
    """Sum of f over two columns' merged runs."""
    ends = np.union1d(a[0], b[0])
    lengths = np.diff(ends, prepend=0)
    p, q = a[1][np.searchsorted(a[0], ends)], b[1][np.searchsorted(b[0], ends)]
    return int((divergence(p, q) * lengths).sum())


def _compared(top: int):
    """Blocks with their languages' totals in; sums of pairs and leading terms of the task's blocks out."""
    def run(batches):
        import pyarrow as pa

        pairs: dict[tuple, int] = Counter()
        leading: dict[tuple, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                lang, size, names = row["lang"], row["size"] or 0, row["group_names"]
                held = dict(zip(row["sources"] or (), zip(row["ends"] or (), row["counts"] or ())))
                runs, totals = [], row["group_totals"]
                for name, total in zip(names, totals):
                    ends, counts = held.get(name, ([size], [0]))
                    runs.append((np.array(ends, np.int64), shares(counts, total, row["kept"]) if size else None))
                for i, name in enumerate(names):
                    for j in range(i):
                        pairs[lang, name, names[j]] += _pair_value(runs[i], runs[j]) if size else 0
                if not size:
                    continue
                whole = np.zeros(size, np.int64)
                for ends, counts in held.values():
                    whole += np.repeat(counts, np.diff(ends, prepend=0))
                q = shares(whole, sum(totals), row["kept"])
                for name, (ends, counts) in held.items():
                    lengths = np.diff(ends, prepend=0)
                    p = np.repeat(runs[names.index(name)][1], lengths)
                    f = np.where((np.repeat(counts, lengths) > 0) & (p > q), divergence(p, q), -1)
                    floor = max(0, np.partition(f, -top)[-top]) if len(f) > top else 0
                    best = leading.setdefault((lang, name), [])
                    best += [(-int(f[i]), row["terms"][i].encode()) for i in np.flatnonzero(f >= floor)]
                    best.sort()
                    del best[top:]
        out = [(lang, x, "pair", y, v) for (lang, a, b), v in pairs.items() for x, y in ((a, b), (b, a))]
        out += [(lang, name, "term", t.decode(), -f) for (lang, name), best in leading.items() for f, t in best]
        for at in range(0, len(out), 50_000):
            columns = zip(*out[at:at + 50_000])
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), pa.int64() if i == 4 else pa.string()) for i, c in enumerate(columns)],
                names=["lang", "source", "part", "item", "value"])

    return run


def audit(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): every source against the other sources of its language, and its leading terms."""
    words = stored(vocabulary(documents, min_documents), "divergence-vocabulary")
    kept = words.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    totals = (words.select("lang", F.explode("cells").alias("c")).groupBy("lang", F.col("c.source").alias("source"))
              .agg(F.sum("c.n").alias("total")))
    groups = documents.select(text_of("lang").alias("lang"), text_of("source").alias("source")).distinct()
    # one row a language: as long as the language has sources, which the pairs asked for square anyway
    langs = (groups.join(totals, ["lang", "source"], "left").groupBy("lang")
             .agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("g"))
             .join(kept, "lang", "left")
             .select("lang", F.col("g.source").alias("group_names"), F.col("g.total").alias("group_totals"), F.coalesce("kept", F.lit(0)).alias("kept")))
    langs = stored(langs, "divergence-languages")
    blocks = stored(run_length_blocks(words), "divergence-blocks")
    dealt = blocks.withColumn("_salt", F.pmod(F.xxhash64("terms"), F.lit(SALT)).cast("int"))
    copies = langs.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    empty = langs.where("kept = 0").select("*", F.lit(None).cast("int").alias("_salt"))
    joined = dealt.join(copies, ["lang", "_salt"]).unionByName(empty, allowMissingColumns=True).drop("_salt")
    found = arrow_map(joined, _compared(top), "lang string, source string, part string, item string, value bigint")
    # a term stands in one block only, so adding up leaves its value as it is
    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = summed.withColumn("rank", place)
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))
