"""Quality by the perplexity of an interpolated modified Kneser-Ney model of trusted text.

The model is over the bytes of UTF-8 texts, as they are, in n-grams of `ORDER` = 5: an n-gram is a number
of 5 bytes, exact and without hashing, and the tables grow with what the trusted texts hold.

1. Fit: tasks count the n-grams of the trusted texts and send them, sorted and packed, to the shard of
   each; shards add up. Lower orders count the different bytes before. The counts of n-grams and of
   contexts are joined into interpolated probabilities, order by order. Texts meet their labels in a
   shuffle, compressed; a bit filter of at most `FILTER_BITS` first drops those without a trusted label.
2. Resolve: the distinct n-grams of all texts to score are joined with the tables: a seen n-gram has its
   probability, another the weight of its context times that of its end one byte shorter.
3. Score: every block of texts (an Arrow batch) sends each shard the n-grams that fall to it, with the
   texts that hold them and how often, as packed sorted numbers. A shard joins them with its resolved
   n-grams and returns one sum a text; the sums of all shards give the perplexity per character.

A shard holds about `SHARD` resolved n-grams and is dealt to several tasks, by blocks, which stream the
blocks one after another; so no task grows with the corpus. No n-gram has a hot key: it meets its shard
once a block, however often it stands there.

A document is kept if its perplexity is at most its language's threshold: the `QUANTILE` of the
perplexities of that language's trusted texts, times `SLACK`. The mean over n characters scatters as
1 / sqrt(n), so perplexities are compared after division by exp(`SHORT` / sqrt(n)), which is 1.04 at 3000
characters and 1.7 at 14. A language without trusted text takes the threshold over all languages.

Edge cases: null and empty texts have a null perplexity and aren't kept; a null language is a language
of its own; without trusted text the probabilities are uniform and every text with characters is kept;
repeated label rows count a text once; documents with null ids are scored like others and trusted never;
a very long text is a block of its own; equal texts have equal perplexities, and one at its threshold is
kept; columns of any name pass through `keep` untouched; empty tables give no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lineshed.llm.textops import fresh, map_texts, mix64, text_slices, tidy
from lineshed.session import materialize

ORDER = 5
SHARD = 1 << 18
BLOCK_TASK = 1 << 26
BLOCK_BYTES = 6_000_000
MOST_HELD = 1 << 20
FILTER_BITS = 1 << 26
AT_ONCE = 1 << 18
QUANTILE = 0.995
SLACK = 1.2
SHORT = 2.0
U = np.uint64


def mask(order: int) -> int:
    return (1 << 8 * order) - 1


def encoded(texts: list) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def gram_codes(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends in each byte of all payloads, and the number of the payload. Bytes 0 stand before each."""
    pad = b"\0" * (ORDER - 1)
    data = np.frombuffer(pad + pad.join(payloads), dtype=np.uint8)
    sizes = np.array([len(p) for p in payloads], dtype=np.int64)
    inside = np.ones(max(0, len(data) - ORDER + 1), dtype=bool)  # where an n-gram of one payload begins
    ends = np.cumsum(sizes) + np.arange(len(sizes)) * (ORDER - 1)
    inside[(ends[:-1, None] + np.arange(ORDER - 1)).ravel()] = False
    out, done = np.empty(int(sizes.sum()), dtype=U), 0
    for start in range(0, len(inside), AT_ONCE):
        here = inside[start : start + AT_ONCE]
        grams = data[start : start + len(here)].astype(U)
        for k in range(1, ORDER):
            grams <<= U(8)
            grams |= data[start + k : start + k + len(here)]
        grams = grams[here]
        out[done : done + len(grams)] = grams
        done += len(grams)
    return out, np.repeat(np.arange(len(payloads), dtype=np.uint32), sizes)


def runs(rising: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values begins, and how long it is."""
    new = np.ones(len(rising), dtype=bool)
    np.not_equal(rising[1:], rising[:-1], out=new[1:])
    start = np.flatnonzero(new)
    length = np.empty(len(start), dtype=np.uint32)
    length[:-1] = start[1:] - start[:-1]
    length[-1:] = len(rising) - start[-1:]
    return start, length


def squeeze(*columns: np.ndarray) -> bytes:
    """Arrays of whole numbers as one compressed string, byte planes apart."""
    parts = [struct.pack("<I", len(columns))]
    for c in columns:
        c = np.ascontiguousarray(c, dtype="<u8" if c.dtype.itemsize == 8 else "<u4")
        parts.append(struct.pack("<IB", len(c), c.dtype.itemsize))
        parts.append(c.view(np.uint8).reshape(-1, c.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unsqueeze(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    (n,), at, out = struct.unpack_from("<I", raw), 4, []
    for _ in range(n):
        rows, width = struct.unpack_from("<IB", raw, at)
        at += 5
        planes = np.frombuffer(raw, dtype=np.uint8, count=rows * width, offset=at).reshape(width, rows)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel())
        at += rows * width
    return out


def steps(rising: np.ndarray) -> np.ndarray:
    return np.diff(rising, prepend=rising.dtype.type(0))


def shard_of(grams: np.ndarray, shards: int) -> np.ndarray:
    return (mix64(grams.astype(U)) % U(shards)).astype(np.int64)


def by_shard(grams: np.ndarray, shards: int, often: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that has n-grams, and where they are, in order; with `often`, those of like frequency together, as they pack better."""
    shard = shard_of(grams, shards)
    order = np.argsort(shard if often is None else shard << 6 | np.log2(often).astype(np.int64), kind="stable")
    ends = np.cumsum(np.bincount(shard, minlength=shards))
    for s, end in enumerate(ends.tolist()):
        start = int(ends[s - 1]) if s else 0
        if end > start:
            yield s, order[start:end]


def added(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, rising, with the sums of their counts."""
    g, c = np.concatenate(grams), np.concatenate(counts)
    order = np.argsort(g, kind="stable")
    g, c = g[order], c[order]
    if not len(g):
        return g, c
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    return g[first], np.add.reduceat(c, first)


def count_grams(texts: DataFrame, column: str = "text") -> DataFrame:
    """(g, c): how often each n-gram stands in the texts, a column of strings or of compressed ones.

    Tasks add up before they send, shards afterwards; there are as many shards as shuffle partitions.
    """
    plain = dict(texts.dtypes)[column] == "string"
    shards = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def send(grams: list, counts: list) -> Iterator[pa.RecordBatch]:
        g, c = added(grams, counts)
        rows = [(s, squeeze(steps(g[at]), c[at])) for s, at in by_shard(g, shards)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "z"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts, held = [], [], 0
        unpress = zstandard.ZstdDecompressor()
        for _, found in text_slices(batches):
            own, _ = gram_codes(encoded(found) if plain else [unpress.decompress(z) for z in found])
            own.sort()
            first, often = runs(own)
            grams.append(own[first])
            counts.append(often.astype(U))
            held += len(first)
            if held > MOST_HELD:
                g, c = added(grams, counts)
                if 2 * len(g) > MOST_HELD:
                    yield from send([g], [c])
                    grams, counts, held = [], [], 0
                else:
                    grams, counts, held = [g], [c], len(g)
        if grams:
            yield from send(grams, counts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, grams, counts, held = None, [], [], 0

        def done() -> Iterator[pa.RecordBatch]:
            g, c = added(grams, counts)
            for k in range(0, len(g), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(g[k : k + 100_000].astype(np.int64)), pa.array(c[k : k + 100_000].astype(np.int64))], names=["g", "c"])

        for batch in batches:
            for s, z in zip(batch.column(0).to_pylist(), batch.column(1)):
                if s != shard and grams:
                    yield from done()
                    grams, counts, held = [], [], 0
                shard = s
                delta, c = unsqueeze(z.as_py())
                grams.append(np.cumsum(delta, dtype=U))
                counts.append(c)
                held += len(c)
                if held > 2 * MOST_HELD:
                    g, c = added(grams, counts)
                    grams, counts, held = [g], [c], 0
        if grams:
            yield from done()

    sent = texts.select(F.col(column).alias("t")).mapInArrow(tidy(count), "shard int, z binary")
    return sent.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(tidy(add), "g long, c long")


def discounts(tables: list[DataFrame]) -> list[tuple[float, float, float]]:
    """For each table the modified Kneser-Ney discounts for counts of 1, 2 and more."""
    every = None
    for k, table in enumerate(tables):
        part = table.filter("c <= 4").groupBy("c").agg(F.count("*").alias("n")).withColumn("k", F.lit(k))
        every = part if every is None else every.unionByName(part)
    found = {(r["k"], r["c"]): r["n"] for r in every.collect()}  # four rows a table
    out = []
    for k in range(len(tables)):
        n1, n2, n3, n4 = (found.get((k, c), 0) for c in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        raw = (1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else 2 * y, 3 - 4 * y * n4 / n3 if n3 else 3 * y)
        out.append(tuple(min(max(d, 0.05), m - 0.05) for m, d in enumerate(raw, 1)))
    return out


@dataclass
class Model:
    """Tables by order: the seen n-grams (g, p), interpolated, and the contexts (h, gamma), the weight of the lower order."""

    seen: list[DataFrame]
    contexts: list[DataFrame]


def _small(table: DataFrame, order: int) -> DataFrame:
    """Tables of n-grams of up to 2 bytes have at most 65,536 rows and are sent to all tasks."""
    return F.broadcast(table) if order <= 2 else table


def fit(trusted: DataFrame, column: str = "text") -> Model:
    """Counts all texts, plain or compressed, and joins the shards of counts order by order, lowest first."""
    counts = [materialize(count_grams(trusted, column), "grams")]
    for order in range(ORDER - 1, 0, -1):  # lower orders count the different bytes before
        counts.insert(0, materialize(counts[0].groupBy(F.col("g").bitwiseAND(F.lit(mask(order))).alias("g")).agg(F.count("*").alias("c")), "grams"))
    seen, contexts = [], []
    for order, (table, (d1, d2, d3)) in enumerate(zip(counts, discounts(counts)), 1):
        d = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        own = table.withColumn("h", F.shiftright("g", 8))
        of_context = materialize(
            own.groupBy("h").agg(F.sum("c").alias("total"), F.sum(d).alias("off")).select("h", "total", (F.col("off") / F.col("total")).alias("gamma")), "contexts"
        )
        joined = own.join(_small(of_context, order - 1), "h")
        if order == 1:
            joined = joined.withColumn("q", F.lit(1.0 / 256))
        else:
            lower = seen[-1].select(F.col("g").alias("s"), F.col("p").alias("q"))
            joined = joined.withColumn("s", F.col("g").bitwiseAND(F.lit(mask(order - 1)))).join(_small(lower, order - 1), "s")
        seen.append(materialize(joined.select("g", ((F.col("c") - d) / F.col("total") + F.col("gamma") * F.col("q")).alias("p")), "probabilities"))
        contexts.append(of_context.select("h", "gamma"))
    return Model(seen, contexts)


def resolve(model: Model, grams: DataFrame) -> DataFrame:
    """(g, logp) for each n-gram of the distinct ones in `grams`, by joins with the tables, lowest order first."""
    wanted = [grams.select("g")]
    for order in range(ORDER - 1, 0, -1):
        wanted.append(wanted[-1].select(F.col("g").bitwiseAND(F.lit(mask(order))).alias("g")).distinct())
    lower = None
    for order, (seen, contexts) in enumerate(zip(model.seen, model.contexts), 1):
        rows = wanted[ORDER - order].join(_small(seen, order), "g", "left")
        rows = rows.withColumn("h", F.shiftright("g", 8)).join(_small(contexts, order - 1), "h", "left")
        if lower is None:
            rows = rows.withColumn("q", F.lit(1.0 / 256))
        else:
            rows = rows.withColumn("s", F.col("g").bitwiseAND(F.lit(mask(order - 1)))).join(_small(lower, order - 1), "s")
        p = F.coalesce("p", F.coalesce("gamma", F.lit(1.0)) * F.col("q"))
        lower = rows.select(F.col("g").alias("s"), p.alias("q"))
    return lower.select(F.col("s").alias("g"), F.ln("q").alias("logp"))


def _requests(payloads: list[bytes], shards: int) -> Iterator[tuple[int, bytes]]:
    """For each shard the n-grams of a block, the texts that hold each, and how often."""
    grams, owner = gram_codes(payloads)
    bits = max(1, (len(payloads) - 1).bit_length())
    pairs = grams  # ORDER bytes and a text's number below 2^24
    pairs <<= U(bits)
    pairs |= owner
    del grams, owner
    pairs.sort()
    first, often = runs(pairs)
    key = pairs[first]
    del pairs, first
    holder = (key & U((1 << bits) - 1)).astype(np.uint32)
    key >>= U(bits)
    start, holders = runs(key)
    key = key[start]
    gap = holder.copy()
    gap[1:] -= holder[:-1]
    gap[start] = holder[start]
    del holder
    for s, at in by_shard(key, shards, holders):
        n = holders[at].astype(np.int64)
        rows = np.repeat(start[at] - np.cumsum(n) + n, n)
        rows += np.arange(len(rows))
        yield s, squeeze(steps(key[at]), holders[at], gap[rows], often[rows])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Batches put together, or cut, to about `BLOCK_BYTES` of text, one row at least, and their texts."""
    held: list[tuple[pa.RecordBatch, list]] = []
    size = 0

    def whole() -> tuple[pa.RecordBatch, list]:
        table = pa.Table.from_batches([b for b, _ in held]).combine_chunks()
        return table.to_batches()[0], [t for _, texts in held for t in texts]

    for batch, texts in text_slices(batches, BLOCK_BYTES):
        own = batch.column(batch.num_columns - 1).nbytes
        if held and size + own > BLOCK_BYTES:
            yield whole()
            held, size = [], 0
        held.append((batch, texts))
        size += own
    if held:
        yield whole()


def _sums(request: bytes, grams: np.ndarray, logp: np.ndarray, texts: int) -> np.ndarray:
    """For each text of a block the sum over a shard's n-grams of their logarithms."""
    delta, holders, gap, often = unsqueeze(request)
    value = logp[np.searchsorted(grams, np.cumsum(delta, dtype=U))]
    holders, running = holders.astype(np.int64), np.cumsum(gap, dtype=np.int64)
    del delta, gap
    ends = np.cumsum(holders)
    before = np.concatenate([[0], running[ends[:-1] - 1]])
    running -= np.repeat(before, holders)
    weight = np.repeat(value, holders)
    weight *= often
    return np.bincount(running, weight, minlength=texts)


def perplexity(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """The columns in `keep`, the perplexity of each whole text, per character, and how many characters it has."""
    named = docs.select(*keep, F.col(text).alias(fresh("__text", keep)))
    last = named.columns[-1]
    grams = materialize(count_grams(named, last), "asked")
    size = grams.agg(F.count("*").alias("n"), F.coalesce(F.sum("c"), F.lit(0)).alias("bytes")).first()
    resolved = materialize(resolve(model, grams), "resolved")
    shards = max(1, -(-size["n"] // SHARD))
    deals = max(1, -(-size["bytes"] // (BLOCK_TASK * shards)))
    kept = StructType(named.select(*keep).schema.fields)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, (batch, found) in enumerate(_blocks(batches)):
            block = task << 32 | number
            sizes = pa.array([len(t or "") for t in found], pa.int64())
            head = pa.RecordBatch.from_arrays([*batch.columns[:-1], sizes], names=[str(k) for k in range(batch.num_columns)])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, head.schema) as out:
                out.write_batch(head)
            deal = block % deals
            rows = [(deal, 1, block, -1, sink.getvalue().to_pybytes(), len(found))]
            rows += [(s * deals + deal, 1, block, s, z, len(found)) for s, z in _requests(encoded(found), shards)]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["task", "kind", "block", "shard", "z", "texts"])

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, logp = batch.column(0).to_numpy().astype(U), batch.column(1).to_numpy().astype(np.float32)
            order = np.argsort(g)
            rows = [(s, squeeze(steps(g[order[at]]), logp[order[at]].view(np.uint32))) for s, at in by_shard(g[order], shards)]
            for deal in range(deals):
                yield pa.RecordBatch.from_arrays([pa.array([s * deals + deal for s, _ in rows], pa.int32()), pa.array([z for _, z in rows], pa.binary())], names=["task", "z"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, parts, table = None, [], None
        for batch in batches:
            for k, (own, kind, block, shard, n) in enumerate(zip(*[batch.column(c).to_pylist() for c in (0, 1, 2, 3, 5)])):
                z = batch.column(4)[k].as_py()
                if own != task:
                    task, parts, table = own, [], None
                if kind == 0:
                    delta, logp = unsqueeze(z)
                    parts.append((np.cumsum(delta, dtype=U), logp.view(np.float32)))
                    continue
                if table is None:
                    g, logp = (np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros(0, U), np.zeros(0))
                    order = np.argsort(g)
                    table, parts = (g[order], logp[order].astype(np.float64)), []
                sums = z if shard < 0 else _sums(z, *table, n).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([shard], pa.int32()), pa.array([sums], pa.binary())], names=["block", "shard", "z"])

    def finish(rows: pa.Table) -> pa.Table:
        rows = sorted(zip(rows["shard"].to_pylist(), rows["z"].to_pylist()))
        head = pa.ipc.open_stream(rows[0][1]).read_all()
        sizes = head.column(head.num_columns - 1).to_numpy()
        total = np.zeros(len(sizes))
        for _, z in rows[1:]:
            total += np.frombuffer(z)
        value = np.exp(-total / np.maximum(sizes, 1))
        return pa.table([*head.columns[:-1], pa.array(value, mask=sizes == 0), pa.array(sizes)], names=[*keep, "perplexity", "chars"])

    fields = "task int, kind int, block long, shard int, z binary, texts int"
    offered = resolved.mapInArrow(tidy(offer), "task int, z binary").select("task", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("block"), F.lit(-1).alias("shard"), "z", F.lit(0).alias("texts"))
    met = named.mapInArrow(tidy(ask), fields).unionByName(offered).repartitionById(shards * deals, "task").sortWithinPartitions("task", "kind")
    summed = met.mapInArrow(tidy(join), "block long, shard int, z binary")
    schema = StructType([*kept.fields, *StructType.fromDDL("perplexity double, chars long").fields])
    return summed.groupBy("block").applyInArrow(finish, schema)


def allowance(chars: Column) -> Column:
    """How much more perplexity a short text may have by chance."""
    return F.exp(F.lit(SHORT) / F.sqrt(F.greatest(chars, F.lit(1))))


def thresholds(scored: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, lang: str = "lang") -> DataFrame:
    """(lang, threshold) for each language of the rows, and one row for all with `everything` true.

    The exact quantile of the logarithms of perplexities rounded up to 1/1000: they are at least 0 and
    bounded by that of the rarest n-gram, so there are a few thousand values a language.
    """
    rounded = scored.filter("perplexity is not null").select(F.col(lang).alias("lang"), F.ceil(F.ln(F.col("perplexity") / allowance(F.col("chars"))) * 1000).alias("v"))
    counted = rounded.groupBy("lang", "v").agg(F.count("*").alias("n"))
    every = counted.groupBy("v").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "v", "n", F.lit(True).alias("everything"))
    both = counted.select("lang", "v", "n", F.lit(False).alias("everything")).unionByName(every)
    w = Window.partitionBy("everything", "lang")
    ranked = both.withColumn("below", F.sum("n").over(w.orderBy("v"))).withColumn("all", F.sum("n").over(w))
    return ranked.filter(F.col("below") >= F.lit(quantile) * F.col("all")).groupBy("everything", "lang").agg((F.exp(F.min("v") / 1000) * slack).alias("threshold"))


def trusted_keys(labels: DataFrame, key: str) -> DataFrame:
    """Ids of the documents that labels call good and not toxic."""
    return labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").alias(key)).distinct()


def filter_bits(keys: DataFrame, key: str) -> np.ndarray:
    """A bit filter of the keys, 16 bits a key and `FILTER_BITS` (8 MiB) at most: beyond that it lets more through, never fewer."""
    bits = min(FILTER_BITS, max(1 << 12, 1 << (16 * keys.count()).bit_length()))
    at = keys.select(F.explode(F.array(*_positions(key, bits))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    rows = words.toPandas()  # at most FILTER_BITS / 64 rows
    out = np.zeros(bits // 64, dtype=np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out


def _positions(key: str, bits: int) -> list[Column]:
    one, two = F.xxhash64(key), F.xxhash64(key, F.lit(1))
    return [h.bitwiseAND(F.lit(bits - 1)) for h in (one, F.shiftrightunsigned(one, 32), two, F.shiftrightunsigned(two, 32))]


def trusted_texts(docs: DataFrame, trusted: DataFrame, text: str, key: str) -> DataFrame:
    """(key, __z): the compressed texts of the trusted keys.

    Documents that the bit filter of the keys rules out aren't moved; the others meet the keys in a shuffle.
    """
    known = filter_bits(trusted, key)
    bits = 64 * len(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            hit = np.ones(batch.num_rows, dtype=bool)
            for c in batch.columns[1:5]:
                at = c.to_numpy()
                hit &= (known[at >> 6] >> (at & 63) & 1).astype(bool)
            found = batch.filter(pa.array(hit))
            z = [press.compress(t.as_py().encode("utf-8", "surrogatepass")) for t in found.column(5)]
            yield pa.RecordBatch.from_arrays([found.column(0), pa.array(z, pa.binary())], names=[key, "__z"])

    own = docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull() & (F.col(text) != "")).select(key, *[p.alias(f"__{k}") for k, p in enumerate(_positions(key, bits))], F.col(text).alias("__text"))
    sent = own.mapInArrow(tidy(run), StructType([docs.select(key).schema[0], *StructType.fromDDL("__z binary").fields]))
    return sent.hint("merge").join(trusted, key, "left_semi")


def trusted_keys(labels: DataFrame, key: str) -> DataFrame:
    """Ids of the documents that labels call good and not toxic."""
    return labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").alias(key)).distinct()


def scored_and_bound(docs: DataFrame, labels: DataFrame, text: str, key: str, lang: str, quantile: float, slack: float, more: tuple[str, ...] = ()) -> tuple[DataFrame, Column]:
    """Each row's (doc_id, lang, *more, perplexity, chars), and the threshold of its language as a column over `lang`."""
    trusted = trusted_keys(labels, "doc_id")
    named = docs.select(F.col(key).alias("doc_id"), F.col(lang).alias("lang"), *more, F.col(text).alias("text"))
    model = fit(trusted_texts(named, trusted, "text", "doc_id"), "__z")
    scored = materialize(perplexity(named, model, keep=("doc_id", "lang", *more)), "scored")
    known = scored.hint("merge").join(trusted, "doc_id", "left_semi")
    rows = thresholds(known, quantile, slack).collect()  # one for each language
    bound = F.lit(next((float(r["threshold"]) for r in rows if r["everything"]), float("inf")))
    for r in rows:
        if not r["everything"]:
            bound = F.when(F.col("lang").eqNullSafe(F.lit(r["lang"])), F.lit(float(r["threshold"]))).otherwise(bound)
    return scored, bound


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """(doc_id, lang, perplexity, threshold, kept) for each row; trusted are labels of quality 1 and toxic 0."""
    scored, bound = scored_and_bound(docs, labels, text, key, lang, quantile, slack)
    found = scored.withColumn("threshold", bound * allowance(F.col("chars")))
    return found.select("doc_id", "lang", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """The rows of docs that are kept, with all their columns.

    A row meets its verdict by two hashes of its id, language and text, on which alone the verdict depends.
    """
    one, two = fresh("__row", docs.columns), fresh("__row2", docs.columns)
    known = docs.withColumns({one: F.xxhash64(key, lang, text), two: F.xxhash64(F.lit(2), key, lang, text)})
    renamed = known.select(F.col(key).alias("doc_id"), F.col(lang).alias("lang"), F.col(one).alias("__row"), F.col(two).alias("__row2"), F.col(text).alias("text"))
    scored, bound = scored_and_bound(renamed, labels, "text", "doc_id", "lang", quantile, slack, ("__row", "__row2"))
    fine = scored.filter(F.col("perplexity") <= bound * allowance(F.col("chars"))).select(F.col("__row").alias(one), F.col("__row2").alias(two)).distinct()
    return known.join(fine, [one, two], "left_semi").select(*docs.columns)
