"""Mixture-controlled packing: deficit round-robin over source queues into fixed windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewise.llm.common import Scratch, list_array, table, text_slices
from casewise.llm.tokens import word_ids

SEQUENCE_TOKENS = 4096
END_ID = 2
#: A source is served when it is owed this many tokens, so that a window holds few pieces.
QUANTUM = 256
#: Tokens after which a chunk of documents closes; a chunk is packed by one task.
CHUNK_TOKENS = 1 << 20


def _flush(chunk: int, segments: list, kind: pa.DataType, width: int) -> pa.RecordBatch:
    """A chunk as one row; ``segments``: (doc, source, start, total, ids)."""
    docs, sources, starts, totals, parts = zip(*segments)
    lengths = np.array([len(p) // width for p in parts], np.int64)
    counts = np.array([len(docs)])
    return pa.RecordBatch.from_arrays(
        [
            pa.array([TaskContext.get().partitionId()], pa.int64()),
            pa.array([chunk], pa.int64()),
            pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), pa.array(docs, kind)),
            pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), pa.array(sources, pa.string())),
            list_array(np.array(starts, np.int64), counts, pa.int64()),
            list_array(np.array(totals, np.int64), counts, pa.int64()),
            list_array(lengths, counts, pa.int64()),
            pa.array([b"".join(parts)], pa.binary()),
            pa.array([width], pa.int64()),
            pa.array([int(lengths.sum())], pa.int64()),
        ],
        ["part", "chunk", "docs", "sources", "starts", "totals", "lengths", "ids", "width", "tokens"],
    )


def _chunks(path: str, end_id: int, most: int, segment: int):
    """Tokenise documents in the order they come, in segments; one row per run of documents with about ``most`` ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = word_ids(path)
        width = store.kind.itemsize
        end = np.array([end_id], store.kind).tobytes()
        chunk, held, segments, kind = 0, 0, [], pa.int64()
        for batch in batches:
            kind = batch.column("id").type
            ids, names = (batch.column(c).to_pylist() for c in ("id", "source"))
            for first, past, data, bounds in text_slices(batch.column("text")):
                tokens, counts = store.encode_slice(data, bounds)
                raw, at = tokens.tobytes(), 0
                for doc, name, count in zip(ids[first:past], names[first:past], counts.tolist()):
                    part = raw[at : at + count * width] + end
                    at += count * width
                    for start in range(0, count + 1, segment):
                        segments.append((doc, name or "", start, count + 1, part[start * width : (start + segment) * width]))
                    held += count + 1
                    if held >= most:
                        yield _flush(chunk, segments, kind, width)
                        chunk, held, segments = chunk + 1, 0, []
        if segments:
            yield _flush(chunk, segments, kind, width)

    return cut


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per segment with its place on the axis that all sources share.

    A segment stands at the tokens of its source before it, divided by the source's share. Sources without a
    share stand behind all others.
    """
    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            names = one.column("sources").flatten().to_pylist()
            lengths = one.column("lengths").flatten().to_pylist()
            ids, width = one.column("ids")[0].as_buffer(), one.column("width")[0].as_py()
            axis = {r["source"]: r for r in one.column("axis")[0].as_py()}
            served = {s: r["served"] for s, r in axis.items()}
            places, bounds = [], [0]
            for name, length in zip(names, lengths):
                share = axis[name]["share"]
                places.append(served[name] / share if share > 0 else axis[name]["far"] + 1.0 + served[name])
                served[name] += length
                bounds.append(bounds[-1] + length * width)
            data = pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(np.array(bounds, np.int32)), ids])
            yield pa.RecordBatch.from_arrays(
                [pa.array(places, pa.float64()), one.column("docs").flatten(), one.column("sources").flatten(),
                 one.column("starts").flatten(), one.column("totals").flatten(), data, pa.array([width] * len(names), pa.int64())],
                ["place", "doc", "source", "start", "total", "ids", "width"],
            )


def _gather(most: int):
    """Segments in the order they come; one row per run of them with about ``most`` ids."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, segments, kind, width = 0, 0, [], pa.int64(), 1
        for batch in batches:
            kind = batch.column("doc").type
            columns = (batch.column(c).to_pylist() for c in ("doc", "source", "start", "total", "ids", "width"))
            for *segment, width in zip(*columns):
                segments.append(segment)
                held += len(segment[-1]) // width
                if held >= most:
                    yield _flush(chunk, segments, kind, width)
                    chunk, held, segments = chunk + 1, 0, []
        if segments:
            yield _flush(chunk, segments, kind, width)

    return gather


def sequence_lengths(tokens: int, window: int) -> list[int]:
    """Full windows, then the rest as powers of two, which need no padding."""
    rest = tokens % window
    return [window] * (tokens // window) + [1 << b for b in range(window.bit_length(), -1, -1) if rest >> b & 1]


def deficit_round_robin(queues, shares, owed, window: int, quantum: int):
    """(document, start, length) in the order of the token stream.

    ``queues``: per source its documents (index, length) in order; ``shares``: the target share of the
    tokens; ``owed``: the deficit to start with, in tokens. After every served token each source is owed its
    share of a token more. The source that is owed most is served next, up to what it is owed but a
    quantum at least and the rest of the window at most; what remains is carried to the next window.
    """
    served = {s: 0 for s in queues}
    place = {s: [0, 0] for s in queues}  # document in the queue, ids of it already served
    total = 0
    while queues:
        source = max(queues, key=lambda s: (owed[s] + shares[s] * total - served[s], s))
        due = owed[source] + shares[source] * total - served[source]
        space = window - total % window
        want = min(space, max(quantum, int(due)))
        queue, at = queues[source], place[source]
        while want and at[0] < len(queue):
            doc, length = queue[at[0]]
            n = min(want, length - at[1])
            yield doc, at[1], n
            want, total, served[source] = want - n, total + n, served[source] + n
            at[1] += n
            if at[1] == length:
                at[0], at[1] = at[0] + 1, 0
        if at[0] == len(queue):
            del queues[source]


def _pack(window: int, quantum: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                docs = one.column("docs").flatten()
                names = one.column("sources").flatten().to_pylist()
                lengths, starts, totals = (one.column(c).flatten().to_numpy() for c in ("lengths", "starts", "totals"))
                ids, width = one.column("ids")[0].as_buffer(), one.column("width")[0].as_py()
                wide = memoryview(np.frombuffer(ids, f"<u{width}").astype("<u4")).cast("B")
                first = np.zeros(len(lengths) + 1, np.int64)
                np.cumsum(lengths, out=first[1:])
                queues: dict[str, list] = {}
                head = list(range(len(names)))  # the first of a document's segments that stand together here
                for at, name in enumerate(names):
                    queue = queues.setdefault(name, [])
                    if queue and 0 < starts[at] == starts[queue[-1][0]] + lengths[queue[-1][0]]:
                        head[at] = head[queue[-1][0]]
                    queue.append((at, int(lengths[at])))
                plan = {r["source"]: r for r in one.column("plan")[0].as_py()}
                shares = {s: plan[s]["share"] for s in queues}
                owed = {s: plan[s]["owed"] for s in queues}
                base = one.column("base")[0].as_py()
                sizes = sequence_lengths(int(lengths.sum()), window)
                out, sequence, offset = [], 0, 0
                for doc, start, length in deficit_round_robin(queues, shares, owed, window, quantum):
                    while length:  # the last window is cut further
                        n = min(length, sizes[sequence] - offset)
                        begin = 4 * (int(first[doc]) + start)
                        here = int(starts[doc]) + start
                        if out and out[-1][0] == head[doc] and out[-1][1] + out[-1][2] == here and out[-1][4] == sequence:
                            last = out[-1]
                            last[2] += n
                            last[3] = zlib.crc32(wide[begin : begin + 4 * n], last[3])
                        else:
                            out.append([head[doc], here, n, zlib.crc32(wide[begin : begin + 4 * n]), sequence, offset])
                        start, length, offset = start + n, length - n, offset + n
                        if offset == sizes[sequence]:
                            sequence, offset = sequence + 1, 0
                doc, start, length, crc, sequence, offset = (np.array(c, np.int64) for c in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [docs.take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc),
                     pa.array(totals[doc]), pa.array(sequence + base), pa.array(offset)],
                    ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                )

    return pack


def _running(df: DataFrame, column: str, keys: list[str], name: str) -> DataFrame:
    """Add the sum of ``column`` over all earlier (part, chunk) rows of the same ``keys``, in two levels."""
    inner = Window.partitionBy(*keys, "part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = df.groupBy(*keys, "part").agg(F.sum(column).alias("_sum"))
    zero = F.lit(0).cast("long")
    parts = parts.select(*keys, "part", F.coalesce(F.sum("_sum").over(outer), zero).alias("_before"))
    df = df.withColumn(name, F.coalesce(F.sum(column).over(inner), zero)).join(parts, [*keys, "part"])
    return df.withColumn(name, F.col(name) + F.col("_before")).drop("_before")


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    targets: dict[str, float] | None = None,
    window: int = SEQUENCE_TOKENS,
    id_column: str = "doc_id",
    end_id: int = END_ID,
    quantum: int = QUANTUM,
    chunk_tokens: int = CHUNK_TOKENS,
) -> DataFrame:
    """Pieces (id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents.

    ``targets`` are shares of the tokens per source, by default each source's share of the corpus;
    sources that they leave out are owed nothing and come when no other is owed. Documents are
    tokenised once and written in chunks. Their segments of a quarter of a window are placed on one axis, the tokens of
    the source before them divided by its share, and cut into chunks by that, so that each chunk draws from all
    sources in whatever order the rows come. Each chunk is packed on its own, with the deficits that all chunks
    before it leave: running sums of tokens per source, so no pass over the chunks in order is needed. A
    window is 4096 ids by default; the end of a chunk is cut into powers of two, so nothing is padded.

    A document's ids are followed by ``end_id``; a null or empty text has only that one. A null source
    is the source ''. Null ids are kept, repeated rows are documents of their own, an empty table gives no
    rows. Only ``id_column``, ``source`` and ``text`` are read. ``tokenizer`` is a file path that exists on
    every executor.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    kind = dict(docs.dtypes)[id_column]
    rows = docs.select(F.col(id_column).alias("id"), F.col("source").cast("string").alias("source"), "text")
    columns = (
        f"part long, chunk long, docs array<{kind}>, sources array<string>, starts array<long>, totals array<long>, "
        "lengths array<long>, ids binary, width long, tokens long"
    )
    read = scratch.save(rows.mapInArrow(_chunks(tokenizer, end_id, chunk_tokens, max(1, window // 4)), columns), "read")
    queue = F.explode(F.arrays_zip("sources", "lengths")).alias("q")

    def masses(chunks: DataFrame, name: str) -> DataFrame:
        mass = chunks.select("part", "chunk", queue).groupBy("part", "chunk", F.col("q.sources").alias("source"))
        return scratch.save(mass.agg(F.sum("q.lengths").alias("mass")), name)

    mass = masses(read, "mass")
    shares = mass.groupBy("source").agg(F.sum("mass").cast("double").alias("mass"))
    if targets is None:
        whole = mass.agg(F.sum("mass").cast("double").alias("whole"))
        shares = shares.crossJoin(F.broadcast(whole)).select("source", "mass", (F.col("mass") / F.col("whole")).alias("share"))  # one row
    else:
        given = F.coalesce(*[F.when(F.col("source") == s, F.lit(float(v))) for s, v in targets.items()], F.lit(0.0))
        shares = shares.select("source", "mass", given.alias("share"))
    far = shares.agg(F.coalesce(F.max(F.when(F.col("share") > 0, F.col("mass") / F.col("share"))), F.lit(0.0)).alias("far"))
    shares = scratch.save(shares.select("source", "share").crossJoin(F.broadcast(far)), "shares")  # one row

    axis = _running(mass, "mass", ["source"], "served").join(shares, "source").groupBy("part", "chunk")
    axis = scratch.save(axis.agg(F.collect_list(F.struct("source", "share", "served", "far")).alias("axis")), "axis")
    placed = read.join(axis, ["part", "chunk"]).select("docs", "sources", "starts", "totals", "lengths", "ids", "width", "axis")
    placed = placed.mapInArrow(_place, f"place double, doc {kind}, source string, start long, total long, ids binary, width long")
    placed = placed.repartitionByRange("place", "source").sortWithinPartitions("place", "source")
    chunks = scratch.save(placed.select("doc", "source", "start", "total", "ids", "width").mapInArrow(_gather(chunk_tokens), columns), "chunks")
    scratch.drop(read)
    mass = masses(chunks, "mass")

    sequences = F.floor(F.col("tokens") / window) + F.bit_count(F.col("tokens") % window)
    spans = chunks.select("part", "chunk", "tokens", sequences.alias("sequences"))
    spans = _running(_running(spans, "tokens", [], "earlier"), "sequences", [], "base")
    owed = F.col("share") * F.col("earlier") - F.col("served")
    plan = _running(mass, "mass", ["source"], "served").join(shares, "source").join(spans, ["part", "chunk"])
    plan = plan.groupBy("part", "chunk").agg(
        F.first("base").alias("base"), F.collect_list(F.struct("source", "share", owed.alias("owed"))).alias("plan")
    )
    plan = scratch.save(plan, "plan")
    ready = chunks.join(plan, ["part", "chunk"]).select(
        "docs", "sources", "starts", "totals", "lengths", "ids", "width", "base", "plan"
    )
    pieces = ready.mapInArrow(
        _pack(window, quantum),
        f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
    return pieces.withColumnRenamed("id", id_column)


def op7_mixture_packing(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """All documents as pieces of sequences of 4096 ids."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents") if docs is None else docs
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
