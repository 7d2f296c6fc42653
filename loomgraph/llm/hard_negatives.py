"""Hard negatives by exact integer scores from Kronecker-packed products.

Vectors become integers, floor(256 x). In a block of rows the components of several
candidates are biased to be non-negative and put into separate fields of one wide integer,
so that one multiplication by an anchor's component and one sum over the components give
the scores of all of them: no field's sum can reach the next field. The biases are then
taken off again. Integers of up to 53 bits are held in doubles, which multiply them
exactly; where a single field needs more, Python's unbounded integers take their place.

Rows and anchors are dealt into blocks of bounded size by a hash; each anchor block meets
each row block once, in an equi-join on the two numbers, in two rounds: the first finds
the positives, whose scores limit the negatives that the second finds. A pair of blocks
keeps a few rows for each anchor; a window with a rank limit picks the final ones. No
label, however frequent, is one task's work.

Defined cases: rows with a null id, label or vector, or with a null or non-finite
component take no part; rows equal in id, label and vector count once; rows of one id that
differ are different rows; vectors of different lengths never meet; an empty vector scores
0; ties go to the smaller id; a score beyond 63 bits raises an error; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Rows and anchors in a block, and anchors scored at a time.
BLOCK, STRIP = 4096, 512
SCALE = 256.0
#: Bits of an integer that a double holds.
EXACT = 53
PREPARED = "id bigint, label bigint, anchor boolean, dim int, vec binary, row bigint"


def packed_products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two integer matrices: int64, or Python integers."""
    dim = a.shape[1]
    if not (len(a) and len(c) and dim):
        return np.zeros((len(a), len(c)), dtype=np.int64)
    low_a, low_c = int(a.min()), int(c.min())
    width = max(1, (dim * (int(a.max()) - low_a) * (int(c.max()) - low_c)).bit_length())
    fields = EXACT // width
    kind: type = np.float64
    most = dim * max(abs(low_a), abs(int(a.max()))) * max(abs(low_c), abs(int(c.max())))
    if not fields or most >= 1 << 60:
        fields, kind = 4, object
        a, c = (np.array([[int(x) for x in r] for r in m], dtype=object).reshape(m.shape) for m in (a, c))
    n = -(-len(c) // fields)
    wide = np.zeros((n, dim), dtype=kind)
    for f in range(fields):  # candidates f n .. (f + 1) n - 1 are field f
        part = c[f * n : (f + 1) * n]
        wide[: len(part)] += (part - low_c) * (1 << (f * width))
    got = (a - low_a).astype(kind) @ wide.T
    if kind is np.float64:
        got = got.astype(np.int64)
    out = np.concatenate([(got >> (f * width)) & ((1 << width) - 1) for f in range(fields)], axis=1)[:, : len(c)]
    to = np.int64 if kind is np.float64 else object
    out = out + low_a * c.sum(axis=1).astype(to) + low_c * a.sum(axis=1).astype(to)[:, None] - dim * low_a * low_c
    if to is object and len(out) and max(abs(out.min()), abs(out.max())) >= 1 << 63:
        raise OverflowError("a score of two vectors needs more than 64 bits")
    return out


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that take part, with their integer components: two bytes each where they fit."""
    for batch in batches:
        lists = batch.column("vec").cast(pa.list_(pa.float64()))
        sizes = np.diff(lists.offsets.to_numpy())
        keep = np.array(lists.is_valid().to_numpy(zero_copy_only=False))
        flat = lists.flatten()
        values = np.floor(SCALE * flat.fill_null(math.nan).to_numpy(zero_copy_only=False))
        owner = np.repeat(np.flatnonzero(keep), sizes[keep])
        keep[owner[~np.isfinite(values)]] = False
        at = np.cumsum(sizes * lists.is_valid().to_numpy(zero_copy_only=False)) - sizes
        vecs = []
        for k in np.flatnonzero(keep):
            v = values[at[k] : at[k] + sizes[k]]
            vecs.append(v.astype("<i2" if not len(v) or np.abs(v).max() < 1 << 15 else "<f8").tobytes())
        rows = pa.array(np.flatnonzero(keep))
        columns = [batch.column(c).take(rows) for c in ("id", "label", "anchor")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes[keep].astype(np.int32)), pa.array(vecs, pa.binary())], names=["id", "label", "anchor", "dim", "vec"])


def _matrix(table: pa.Table) -> np.ndarray:
    dim = table["dim"][0].as_py()
    rows = [np.frombuffer(v, dtype="<i2" if len(v) == 2 * dim else "<f8") for v in table["vec"].to_pylist()]
    return np.array(rows, dtype=np.float64).reshape(len(rows), dim)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table[name].combine_chunks().to_numpy(zero_copy_only=False)


def _keys(scores: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Numbers ordered as scores, then against the columns; their shift; one below all."""
    n = scores.shape[1]
    shift = max(1, n.bit_length())
    if scores.dtype != object and scores.size and max(abs(int(scores.min())), abs(int(scores.max()))).bit_length() + shift > 62:
        scores = scores.astype(object)
    least = -(1 << 63) if scores.dtype != object else -(1 << 140)
    return scores * (1 << shift) + np.arange(n - 1, -1, -1), shift, least


def _best_same(anchors: pa.Table, rows: pa.Table, keep: int) -> pa.Table:
    """The first other rows of each anchor's label in this pair of blocks."""
    rows = rows.sort_by([("id", "ascending"), ("row", "ascending")])
    found: dict[str, list] = {"anchor_id": [], "anchor": [], "id": [], "score": []}
    if len(anchors) and len(rows):
        a, c, of, to = _matrix(anchors), _matrix(rows), _numbers(anchors, "label"), _numbers(rows, "label")
        ids, own, own_ids = rows["id"].to_pylist(), anchors["row"].to_pylist(), anchors["id"].to_pylist()
        place = {x: k for k, x in enumerate(zip(ids, rows["row"].to_pylist(), strict=True))}
        for label in np.unique(of):
            there = np.flatnonzero(to == label)
            within = {int(k): n for n, k in enumerate(there)}
            for lo in range(0, len(here := np.flatnonzero(of == label)), STRIP):
                strip = here[lo : lo + STRIP]
                keys, shift, least = _keys(packed_products(a[strip], c[there]))
                for n, k in enumerate(strip):
                    if (me := within.get(place.get((own_ids[k], own[k]), -1))) is not None:
                        keys[n, me] = least
                if keys.shape[1] > keep:
                    keys = np.partition(keys, keys.shape[1] - keep, axis=1)[:, -keep:]
                for n, k in enumerate(strip):
                    for key in keys[n].tolist():
                        if key != least:
                            found["anchor_id"].append(own_ids[k])
                            found["anchor"].append(own[k])
                            found["id"].append(ids[there[len(there) - 1 - key % (1 << shift)]])
                            found["score"].append(key >> shift)
    return pa.table({k: pa.array(v, pa.int64()) for k, v in found.items()})


def _best_other(anchors: pa.Table, rows: pa.Table, keep: int, low: int, high: int) -> pa.Table:
    """For each anchor and positive, the first rows of other labels between the limits."""
    rows = rows.sort_by([("id", "ascending"), ("row", "ascending")])
    found: dict[str, list] = {"anchor": [], "place": [], "id": [], "score": []}
    if len(anchors) and len(rows):
        a, c, of, to = _matrix(anchors), _matrix(rows), _numbers(anchors, "label"), _numbers(rows, "label")
        ids, own, limits = rows["id"].to_pylist(), anchors["row"].to_pylist(), anchors["scores"].to_pylist()
        for lo in range(0, len(a), STRIP):
            keys, shift, least = _keys(packed_products(a[lo : lo + STRIP], c))
            keys[of[lo : lo + STRIP, None] == to] = least
            keys.sort(axis=1)
            for n, line in enumerate(keys):
                for place, score in enumerate(limits[lo + n]):
                    top, bottom = high * score // 100, -(-low * score // 100)
                    if top < bottom:
                        continue
                    k = int(np.searchsorted(line, (top + 1) << shift)) - 1
                    for key in line[max(k - keep + 1, 0) : k + 1].tolist():
                        if key >= bottom << shift and key != least:
                            found["anchor"].append(own[lo + n])
                            found["place"].append(place)
                            found["id"].append(ids[len(ids) - 1 - key % (1 << shift)])
                            found["score"].append(key >> shift)
    return pa.table({k: pa.array(v, pa.int64()) for k, v in found.items()})


def _ranked(df: DataFrame, group: list[str], keep: int) -> DataFrame:
    from pyspark.sql import Window

    by = Window.partitionBy(*group).orderBy(F.desc("score"), "id")
    return df.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= keep)


def hard_negatives(
    rows: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows
    that the condition ``anchors`` holds for. Negatives score between ``low`` and ``high``
    per cent of their positive."""
    d = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull())
    d = d.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col(vector).alias("vec"))
    d = d.mapInArrow(_prepared, PREPARED.rpartition(",")[0]).distinct()
    d = materialize(d.withColumn("row", F.xxhash64("id", "label", "dim", "vec")), "negatives-rows")
    n, m = d.agg(F.count("*"), F.count_if("anchor")).first()
    across, down = max(1, math.ceil(n / block)), max(1, math.ceil(m / block))
    deal = lambda parts, name: F.pmod(F.xxhash64("row", F.lit(name)), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    asked = d.where("anchor").withColumn("g", deal(down, "g"))
    met = d.withColumn("s", deal(across, "s")).select("id", "label", "dim", "vec", "row", "s", every(down).alias("g")).groupBy("dim", "g", "s")

    def meet(left: DataFrame, kernel, schema: str) -> DataFrame:
        return left.withColumn("s", every(across)).groupBy("dim", "g", "s").cogroup(met).applyInArrow(kernel, schema)

    same = meet(asked.select("id", "label", "dim", "vec", "row", "g"), partial(_best_same, keep=positives), "anchor_id bigint, anchor bigint, id bigint, score bigint")
    best = materialize(_ranked(same, ["anchor", "anchor_id"], positives), "negatives-positives")
    by_anchor = best.groupBy(F.col("anchor").alias("row"), F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", F.col("id").alias("positive"), "score"))).alias("best"))
    limited = materialize(asked.join(by_anchor, ["row", "id"]).select("id", "label", "dim", "vec", "row", "g", "best"), "negatives-anchors")
    scored = limited.select("id", "label", "dim", "vec", "row", "g", F.col("best.score").alias("scores"))
    other = meet(scored, partial(_best_other, keep=negatives, low=low, high=high), "anchor bigint, place bigint, id bigint, score bigint")
    chosen = _ranked(other, ["anchor", "place"], negatives)
    each = limited.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"), F.posexplode("best").alias("place", "b"))
    out = each.withColumn("place", F.col("place").cast("long")).join(chosen, ["anchor", "place"]).select(
        "anchor_id", F.col("b.positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        F.col("b.score").alias("positive_score"), F.col("score").alias("negative_score"),
    )
    out = materialize(out, "negatives")
    discard(d, best, limited)
    return out


#: The query: labels of every seventh row are moved on, every fiftieth row is an anchor.
LABEL = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"


def mine_embeddings(embeddings: DataFrame, **options) -> DataFrame:
    """The contract's digest over a table of (vec_id, embedding, label)."""
    moved = embeddings.select("vec_id", "embedding", F.expr(LABEL).alias("label"))
    return hard_negatives(moved, F.col("vec_id") % 50 == 0, **options)


SQL = f"""
WITH rows AS (SELECT vec_id, {LABEL} AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
ranked AS (SELECT anchor_id, positive_id, other AS negative_id, positive_score, score AS negative_score,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS place
  FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, place::INT AS rank, negative_id, positive_score, negative_score FROM ranked WHERE place <= 3
"""
