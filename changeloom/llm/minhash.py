"""MinHash near-duplicate detection: universal hash minima, banding, signature check, exact check, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.common import Words, arrow_schema, batches, materialize, mix, rows, signed, text_bytes
from changeloom.llm.components import components

#: Bands of minima: two texts of similarity 0.85 share none with a probability below 3e-7, two of 0.8 with one below 6e-5.
BANDS, ROWS = 32, 6
#: Members, and shingles, that one block of a large candidate cluster holds.
BLOCK_MEMBERS, BLOCK_SHINGLES = 1024, 500_000
_U = np.uint64


def shingle_sets(data: np.ndarray, starts: np.ndarray, words: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted; A-Z are lower-cased."""
    found = Words(data, starts, lower=True)
    step = np.random.default_rng(words).integers(1, 1 << 63, words + 1, dtype=np.uint64) | _U(1)
    n, h = len(found.hash), found.hash
    runs = np.zeros(max(0, n - words + 1), _U)
    for k in range(words):
        runs += h[k : n - words + 1 + k] * step[k] if n >= words else _U(0)
    runs = mix(runs)
    out = []
    for lo, hi in zip(found.first[:-1], found.first[1:], strict=True):
        if hi - lo >= words:
            out.append(np.unique(runs[lo : hi - words + 1]))
        else:
            whole = (h[lo:hi] * step[: hi - lo]).sum(dtype=_U) + step[-1] * _U(hi - lo)
            out.append(mix(np.array([whole], _U)) if hi > lo else np.zeros(0, _U))
    return out


class _Minima:
    """Universal hash functions a*x+b modulo 2**32 with odd a, and the least value of each over a set."""

    def __init__(self, n: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 1 << 31, n, dtype=np.uint64) * _U(2) + _U(1)).astype(np.uint32)[:, None]
        self.b = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)[:, None]

    def of(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> _U(32)).astype(np.uint32)[None, :]
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for k in range(0, x.shape[1], 512):
            np.minimum(low, (x[:, k : k + 512] * self.a + self.b).min(axis=1), out=low)
        return low


def _signer(words: int, bands: int, band_rows: int, schema: str):
    def sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minima = _Minima(bands * band_rows)
        for part in parts:
            data, starts = text_bytes(part.column(1))
            size, high, low, signature = [], [], [], []
            for lo, hi in batches(starts):
                for s in shingle_sets(data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo], words):
                    size.append(len(s))
                    digest = xxhash.xxh3_128_intdigest(s.tobytes())
                    high.append((digest >> 64) - (1 << 63))
                    low.append((digest & (1 << 64) - 1) - (1 << 63))
                    signature.append(minima.of(s).tobytes() if len(s) else None)
            yield rows(schema, part.column(0), size, high, low, signature)

    return sign


def _band_hashes(parts: Iterator[pa.RecordBatch], bands: int, schema: str) -> Iterator[pa.RecordBatch]:
    for part in parts:
        got = part.column(1).to_pylist()
        m = np.frombuffer(b"".join(got), np.uint32).reshape(len(got), bands, -1).astype(_U)
        keys = np.zeros((len(got), bands), _U)
        for k in range(m.shape[2]):
            keys = mix(keys * _U(0x9E3779B97F4A7C15) + m[:, :, k] + _U(1))
        keys = mix(keys + np.arange(bands, dtype=_U) * _U(0xC2B2AE3D27D4EB4F))
        yield rows(schema, np.repeat(part.column(0).to_numpy(), bands), signed(keys.ravel()))


def _links(ids: np.ndarray, sets: list[np.ndarray], signatures: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int, floor: float) -> list[tuple[int, int]]:
    """Links between members ``left`` and ``right`` that join what was apart: signatures first, then the full sets."""
    root = {int(i): int(i) for i in {*left.tolist(), *right.tolist()}}

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    size = np.array([len(s) for s in sets])
    out = []
    for k in range(0, len(left), 64):
        block = left[k : k + 64]
        agree = np.zeros((len(block), len(right)), np.float32)
        for x, i in enumerate(block):
            agree[x] = (signatures[i][None, :] == signatures[right]).mean(axis=1)
        small, large = np.minimum(size[block][:, None], size[right][None, :]), np.maximum(size[block][:, None], size[right][None, :])
        apart = block[:, None] < right[None, :] if left is right else True
        xs, ys = np.nonzero((agree >= floor) & (100 * small >= percent * large) & apart)
        pairs = sorted(zip((-agree[xs, ys]).tolist(), block[xs].tolist(), right[ys].tolist(), strict=True))
        exact: np.ndarray | None = None
        if len(pairs) > 4 * len(right):
            exact, row, col = _shared(sets, block, right), {int(i): x for x, i in enumerate(block)}, {int(i): y for y, i in enumerate(right)}
        for _, i, j in pairs:
            if (p := top(i)) == (q := top(j)):
                continue
            both = int(exact[row[i], col[j]]) if exact is not None else len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (size[i] + size[j] - both):
                root[max(p, q)] = min(p, q)
                out.append((int(ids[i]), int(ids[j])))
    return out


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, a stretch of the shingles at a time."""
    out = np.zeros((len(left), len(right)), np.float32)
    shingles = np.unique(np.concatenate([sets[i] for i in left]))
    for k in range(0, len(shingles), 2048):
        some = shingles[k : k + 2048]

        def dense(which, some=some):
            m = np.zeros((len(which), len(some)), np.float32)
            for x, i in enumerate(which):
                s = sets[i]
                s = s[np.searchsorted(s, some[0]) : np.searchsorted(s, some[-1], "right")]
                at = np.searchsorted(some, s)
                m[x, at[some[at] == s]] = 1
            return m

        out += dense(left) @ dense(right).T
    return np.rint(out).astype(np.int64)


def _verifier(words: int, percent: int, floor: float):
    def verify(part: pa.Table) -> pa.Table:
        part = part.sort_by("cluster")
        cluster, ids, side = (part.column(c).to_numpy() for c in ("cluster", "doc", "side"))
        data, starts = text_bytes(part.column("text").combine_chunks() if part.num_rows else pa.array([], pa.string()))
        sets = []
        for lo, hi in batches(starts):
            sets += shingle_sets(data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo], words)
        signatures = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint32).reshape(len(ids), -1)
        cut = np.flatnonzero(np.diff(cluster)) + 1
        out = []
        for at in np.split(np.arange(len(ids)), cut):
            left, right = (at, at) if side[at[0]] == 0 else (at[side[at] == 1], at[side[at] == 2])
            out += _links(ids, sets, signatures, left, right, percent, floor)
        return pa.Table.from_batches([rows("a long, b long", [a for a, _ in out], [b for _, b in out])])

    return verify


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 85, bands: int = BANDS, band_rows: int = ROWS) -> DataFrame:
    """Components of documents whose word shingles have a Jaccard similarity of ``percent`` hundredths or more.

    Returns ``doc_id, n_shingles, component_id, kept``, a row per id that is not
    null. The words are runs of other than U+0020 and U+0009 to U+000D with A-Z lower-cased;
    a text with fewer words than a shingle is one shingle; a null, empty or blank text has
    no shingle and is linked with nothing. Rows that repeat an id are one document with several
    texts: it links through each, counts the shingles of the largest, and yields one row. Other
    columns, whatever their names, are ignored; an empty table gives an empty table.

    Equal sets are one class from the start. Classes that share a band form candidate
    clusters (a star per bucket, then components); inside a cluster signatures are
    compared, and every pair that could still join two parts is confirmed on the full
    sets, so a link is lost only where no band is shared along any path. A cluster above
    BLOCK_MEMBERS or BLOCK_SHINGLES is split into blocks, and pairs of blocks are tasks.
    Only links that join parts leave a task, at most one less than its members.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    schema = "doc_id long, n_shingles long, set_high long, set_low long, signature binary"
    signed_docs = materialize(docs.mapInArrow(_signer(words, bands, band_rows, schema), schema))
    classes = materialize(signed_docs.where("n_shingles > 0").groupBy("set_high", "set_low").agg(F.min("doc_id").alias("doc"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n")))
    keys = classes.select("doc", "signature").mapInArrow(lambda parts: _band_hashes(parts, bands, "doc long, band long"), "doc long, band long")
    buckets = keys.groupBy("band").agg(F.min("doc").alias("b"), F.count("*").alias("n")).where("n > 1").select("band", "b")
    candidates = keys.join(buckets, "band").where("doc <> b").select(F.col("doc").alias("a"), "b").distinct()
    clusters = components(candidates).select(F.col("node").alias("doc"), F.col("component").alias("cluster"))
    members = clusters.join(classes, "doc")
    sizes = clusters.join(classes.select("doc", "n"), "doc").groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_MEMBERS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = materialize(members.join(sizes, "cluster").select("cluster", "doc", "signature", "n", "blocks"))
    total = members.agg(F.coalesce(F.sum(F.col("n") * F.col("blocks")), F.lit(0))).first()[0]
    groups = max(1, math.ceil(total / BLOCK_SHINGLES))
    block = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tasks = members.withColumn("block", block).withColumn("other", other).select(
        "cluster", "doc", "signature",
        F.when(F.col("blocks") == 1, F.concat(F.lit("g"), F.pmod(F.xxhash64("cluster"), F.lit(groups)).cast("string"))).otherwise(F.concat_ws("|", "cluster", F.least("block", "other"), F.greatest("block", "other"))).alias("task"),
        F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"),
    )
    work = docs.join(tasks.withColumnRenamed("doc", "doc_id"), "doc_id").select("task", "cluster", F.col("doc_id").alias("doc"), "side", "signature", "text")
    found = work.groupBy("task").applyInArrow(_verifier(words, percent, 0.85 * percent / 100 - 0.05), "a long, b long")
    equal = signed_docs.join(classes, ["set_high", "set_low"]).where("doc_id <> doc").select(F.col("doc_id").alias("a"), F.col("doc").alias("b"))
    labels = components(found.unionByName(equal)).select(F.col("node").alias("doc_id"), "component")
    component = F.coalesce("component", "doc_id")
    sizes = signed_docs.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    return sizes.join(labels, "doc_id", "left").select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
