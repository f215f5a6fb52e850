"""Fill-in-middle transformation by overlapping-chunk decomposition.

A text is a sequence of units, as a predicate of two adjacent characters says: between which of them does a unit begin? Two
cuts, drawn as ranks of units, part it into prefix, middle and suffix. To find where the ranks are, the text is cut into chunks
that overlap by one byte, so that each chunk sees both sides of each border that it owns. The unit starts in each chunk are counted
on their own; prefix sums of the counts give how many units there are and which chunk owns each cut; only these chunks are
scanned again, to find the cut in them.

Texts up to LONG bytes are cut within the batches of a task, all chunks of many texts at once. The chunks of a longer text are
rows: they are dealt over tasks and counted there, a running sum over the (small) counts routes the cuts, and a join sends each to
its chunk.

The output is the text itself (plain), or prefix, suffix and middle with a control string before each, in that order (psm) or suffix
first (spm). restore() takes the text from it.

Cases: a null or empty text is plain, with 0 units. A text that has a control string in it is plain. A null doc_id draws as the
empty string; rows of one doc_id draw alike. All columns of docs pass through, whatever their names; where one has the name of a column added,
that one gets a _ after it. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Bytes that a chunk owns.
CHUNK = 4096
#: Bytes of a text above which its chunks are rows, and bytes of such a chunk.
LONG, LONG_CHUNK = 64 << 20, 4 << 20
#: Percent of texts that change, and percent of these that get the suffix first.
CHANGED, SUFFIX_FIRST = 90, 20
CONTROLS = ("<P>", "<S>", "<M>")

_BREAK = np.zeros(256, bool)
_BREAK[[9, 10, 11, 12, 13, 32]] = True

#: Does a unit start at a byte? before: the byte in front of it.
UNITS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "characters": lambda before, at: (at & 0xC0) != 0x80,
    "words": lambda before, at: _BREAK[before] & ~_BREAK[at],
    "lines": lambda before, at: before == 0x0A,
}

ADDED = ("units", "form", "prefix_units", "middle_units", "prefix_bytes", "middle_bytes", "output")


def _starts(window: np.ndarray, first: np.ndarray | bool, unit) -> np.ndarray:
    """Whether a unit starts at each byte of a window but its first, which is the overlap. first: bytes that begin a text, where one always does."""
    return unit(window[:-1], window[1:]) | first


def _owned(size: int, chunk: int) -> np.ndarray:
    """Where chunks begin in size bytes, and the end."""
    return np.append(np.arange(0, size, chunk), size)


def cut(data: np.ndarray, offsets: np.ndarray, draws: np.ndarray, unit, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text, and for each text two ranks (ascending, from two draws each) and their places in bytes.

    data, offsets: as from common.buffers. draws: two numbers for each text, taken modulo its units and one.
    """
    texts, sizes = len(offsets) - 1, np.diff(offsets)
    # Chunks: none of an empty text.
    each = -(-sizes // chunk)
    first = np.zeros(texts + 1, np.int64)
    np.cumsum(each, out=first[1:])
    text = np.repeat(np.arange(texts), each)
    begins = offsets[text] + chunk * (np.arange(first[-1]) - first[text])
    ends = np.minimum(begins + chunk, offsets[text + 1])
    padded = np.concatenate([np.zeros(1, np.uint8), data])  # byte k is at k + 1, so a chunk's window starts one before it
    at_start = np.zeros(len(data), bool)
    at_start[offsets[:-1][sizes > 0]] = True
    flags = _starts(padded, at_start, unit)
    counts = np.add.reduceat(flags, begins, dtype=np.int64) if len(begins) else np.zeros(0, np.int64)
    before = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=before[1:])
    units = before[first[1:]] - before[first[:-1]]
    ranks = np.sort(draws % (units + 1)[:, None], axis=1)
    places = np.repeat(sizes[:, None], 2, axis=1)
    for side in range(2):
        inside = np.flatnonzero(ranks[:, side] < units)
        wanted = before[first[inside]] + ranks[inside, side]
        owner = np.searchsorted(before, wanted, "right") - 1
        # Only the owning chunks are scanned again.
        for k, rank, c in zip(inside.tolist(), (wanted - before[owner]).tolist(), owner.tolist(), strict=True):
            a, b = int(begins[c]), int(ends[c])
            scanned = _starts(padded[a : b + 1], at_start[a:b], unit)
            places[k, side] = a + int(np.flatnonzero(scanned)[rank]) - offsets[k]
    return units, ranks, places


def _output(text: bytes, at: tuple[int, int], form: str, controls: tuple[bytes, ...]) -> bytes:
    if form == "plain":
        return text
    prefix, middle, suffix = text[: at[0]], text[at[0] : at[1]], text[at[1] :]
    p, s, m = controls
    return b"".join((p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle))


def _drawn(docs: DataFrame, seed: int) -> Column:
    """Four numbers below 2^32 for each document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)))


def _checked(controls: tuple[str, str, str]) -> None:
    """Control strings must be told apart wherever they stand: none may begin within another, or go on from a text into one."""
    for a in controls:
        for b in controls:
            if not a or len(set(controls)) < 3 or (a != b and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b) + (a != b)))):
                raise ValueError("control strings must not be empty, equal, in each other, or begin as another or they themselves end")


def fill_in_middle(
    docs: DataFrame, units: str = "characters", seed: int = 1, changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST,
    controls: tuple[str, str, str] = CONTROLS, long: int = LONG, long_chunk: int = LONG_CHUNK,
) -> DataFrame:
    """docs(doc_id, text) with ADDED: units of the text, form (plain, psm, spm), units and bytes of prefix and middle (null if plain), and the output."""
    _checked(controls)
    names = [common.free_name(docs, x) for x in ADDED]
    draws, plain = common.free_name(docs, "_draws"), common.free_name(docs, "_plain")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    has = F.lit(False)
    for control in controls:
        has |= F.contains(text, F.lit(control))
    rows = docs.withColumn(draws, _drawn(docs, seed)).withColumn(plain, has | (F.octet_length(text) == 0))
    rows = rows.withColumn(plain, F.when(F.col(plain) | (F.col(draws)[2] % 100 >= changed), "plain").when(F.col(draws)[3] % 100 < suffix_first, "spm").otherwise("psm"))
    size = F.octet_length(text)
    if (docs.agg(F.max(size)).first()[0] or 0) <= long:
        return _whole(rows, docs, names, draws, plain, units, controls)
    out = _whole(rows.where(size <= long), docs, names, draws, plain, units, controls)
    return out.unionByName(_in_chunks(rows.where(size > long), docs, names, draws, plain, units, controls, long_chunk))


def _schema(docs: DataFrame, names: list[str]) -> T.StructType:
    kinds = (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.LongType(), T.LongType(), T.StringType())
    return T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))])


def _columns(names: list[str], units, forms: list[str], ranks: np.ndarray, places: np.ndarray, texts: list[bytes], controls) -> dict:
    marks = tuple(x.encode() for x in controls)
    plain = np.array([x == "plain" for x in forms], bool)
    spans = [ranks[:, 0], ranks[:, 1] - ranks[:, 0], places[:, 0], places[:, 1] - places[:, 0]]
    outputs = [_output(t, at, form, marks) for t, at, form in zip(texts, places.tolist(), forms, strict=True)]
    values = [pa.array(units, pa.int64()), pa.array(forms, pa.string()), *(pa.array(x, pa.int64(), mask=plain) for x in spans), pa.array(outputs, pa.binary()).cast(pa.string())]
    return dict(zip(names, values, strict=True))


def _whole(rows: DataFrame, docs: DataFrame, names, draws: str, plain: str, units: str, controls) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part, data, offsets in common.slices(batch):
                drawn = part.column(draws).flatten().to_numpy().reshape(-1, 4)[:, :2]
                n, ranks, places = cut(data, offsets, drawn, UNITS[units])
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                out = _columns(names, n, part.column(plain).to_pylist(), ranks, places, texts, controls)
                yield common.with_columns(part.drop_columns([draws, plain]), **out)

    return rows.mapInArrow(run, _schema(docs, names))


def _in_chunks(rows: DataFrame, docs: DataFrame, names, draws: str, plain: str, units: str, controls, chunk: int) -> DataFrame:
    """The same for long texts, whose chunks are rows."""
    rows, rid = common.numbered(rows, "long-texts")
    data, size = F.col("text").cast("string").cast("binary"), F.octet_length("text")
    # substring() takes bytes of a binary value without reading those before; a chunk has one more in front.
    each = F.transform(F.sequence(F.lit(0), ((size - 1) / F.lit(chunk)).cast("int")), lambda k: F.substring(data, F.greatest(k * chunk, F.lit(1)), F.when(k == 0, chunk).otherwise(chunk + 1)))
    chunks = rows.select(F.col(rid).alias("rid"), F.posexplode(each).alias("k", "data"))
    tasks = max(common.shuffle_partitions(rows.sparkSession), (rows.agg(F.sum(size)).first()[0] or 0) // (16 * chunk))
    chunks = common.as_table(chunks.repartition(int(tasks), "rid", "k"), "chunks")

    def flags(k: int, raw: bytes) -> np.ndarray:
        window = np.frombuffer(raw if k else b"\0" + raw, np.uint8)
        first = np.zeros(len(window) - 1, bool)
        first[0] = k == 0
        return _starts(window, first, UNITS[units])

    def count(batches):
        for batch in batches:
            found = [int(flags(k, x).sum()) for k, x in zip(batch.column("k").to_pylist(), batch.column("data").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("k"), pa.array(found, pa.int64())], names=["rid", "k", "n"])

    def scan(batches):
        for batch in batches:
            found = [k * chunk + int(np.flatnonzero(flags(k, x))[r]) for k, x, r in zip(*(batch.column(c).to_pylist() for c in ("k", "data", "rank")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("side"), pa.array(found, pa.int64())], names=["rid", "side", "place"])

    counts = common.as_table(chunks.mapInArrow(count, "rid long, k int, n long"), "counts")
    totals = counts.groupBy("rid").agg(F.sum("n").alias("units"))
    drawn = rows.select(F.col(rid).alias("rid"), F.slice(draws, 1, 2).alias("h")).join(totals, "rid")
    ranks = drawn.select("rid", "units", F.array_sort(F.transform("h", lambda x: x % (F.col("units") + 1))).alias("ranks"))
    upto = F.sum("n").over(Window.partitionBy("rid").orderBy("k"))
    sums = counts.select("rid", "k", (upto - F.col("n")).alias("before"), upto.alias("upto"))
    routed = ranks.select("rid", F.posexplode("ranks").alias("side", "rank")).join(sums, "rid").where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("upto")))
    places = chunks.join(routed.select("rid", "k", "side", (F.col("rank") - F.col("before")).alias("rank")), ["rid", "k"]).mapInArrow(scan, "rid long, side int, place long")
    places = places.groupBy("rid").agg(*(F.max(F.when(F.col("side") == s, F.col("place"))).alias(f"place{s}") for s in range(2)))
    found = ranks.join(places, "rid", "left").select(F.col("rid").alias(rid), F.struct("units", "ranks", "place0", "place1").alias(found_name := common.free_name(rows, "_found")))

    def build(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                x, text = row.column(found_name)[0].as_py(), row.column("text")[0].as_py().encode()
                at = [len(text) if x[p] is None else x[p] for p in ("place0", "place1")]  # no chunk owns a rank of all units: it is the end
                out = _columns(names, [x["units"]], row.column(plain).to_pylist(), np.array([x["ranks"]]), np.array([at]), [text], controls)
                yield common.with_columns(row.drop_columns([draws, plain, rid, found_name]), **out)

    return rows.join(found, rid).select(*rows.columns, found_name).mapInArrow(build, _schema(docs, names))


def restore(output: Column, form: Column, controls: tuple[str, str, str] = CONTROLS) -> Column:
    """The text that an output of this form was made of."""
    parts = F.split(output, "|".join(map(re.escape, controls)), -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return out.select(
        "doc_id", F.col("units").alias("n"), "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
r AS (SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b, ('0x' || h[17:24])::BIGINT % 100 AS p, ('0x' || h[25:32])::BIGINT % 100 AS o FROM d),
f AS (SELECT doc_id, t, n, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR p >= 90 THEN 'plain' WHEN o < 20 THEN 'spm' ELSE 'psm' END AS form,
  least(a, b) AS low, greatest(a, b) AS high FROM r),
x AS (SELECT *, substring(t, 1, low) AS prefix, substring(t, low + 1, high - low) AS middle, substring(t, high + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM x
"""
