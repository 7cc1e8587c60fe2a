"""BPE by content-defined chunks: a chunk that several documents share is encoded once.

1. A rolling hash over the UTF-8 bytes of a text decides where chunks end, so equal passages fall
   into equal chunks wherever they stand.
2. The digests of all chunks are counted by document. A chunk of more than one document is encoded
   once, from one document that holds it; its ids then travel to every document that has it.
3. Each document puts the ids of its chunks together. Where two chunks meet, the ids around the
   seam are made anew: the stretch between the last sure piece border before the seam and the
   first after it is re-encoded, and grows by further borders until both ends agree exactly with
   the token borders of the chunks around it (or the text ends). A sure border is an ASCII blank
   after a non-blank character; the pre-tokenizer always splits there.
4. Decoding looks ids up in the table of token bytes.

Edge cases: null text is the empty text, with no ids; a text without blanks is re-encoded whole;
rows that repeat an id or have none are each encoded for themselves; an empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplecast.llm.common import slices, stored
from ripplecast.llm.tokens import Codec, codec

LEAST_CHUNK, MEAN_BITS, MOST_CHUNK = 256, 10, 8192  # bytes; a cut every 2**MEAN_BITS or so
_GEAR = np.random.default_rng(20240501).integers(0, 1 << 32, 256, dtype=np.uint32)
_BORDER = re.compile(rb"(?<=[\x21-\x7e])(?=[ \n])")


def rolling_hash(raw: np.ndarray) -> np.ndarray:
    """Gear hash over the last 32 bytes at every place, by doubling the window five times."""
    found = _GEAR[raw]
    for step in (1, 2, 4, 8, 16):
        wider = found.copy()
        wider[step:] += found[:-step] << np.uint32(step)
        found = wider
    return found


def cut_points(texts: list[bytes]) -> list[list[int]]:
    """Ends of the chunks of each text; the last is the text's length."""
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(text) for text in texts])
    hits = np.flatnonzero(rolling_hash(raw) >> np.uint32(32 - MEAN_BITS) == 0) + 1
    hits = hits[hits < len(raw)]
    hits = hits[raw[hits] & 0xC0 != 0x80]  # never inside a character
    spans = np.searchsorted(hits, ends).tolist()
    found, first, start = [], 0, 0
    for end, last in zip(ends.tolist(), spans):
        cuts, at = [], 0
        for hit in [*(hits[first:last] - start).tolist(), end - start]:
            while hit - at > MOST_CHUNK:
                at += MOST_CHUNK
                while raw[start + at] & 0xC0 == 0x80:
                    at -= 1
                cuts.append(at)
            if hit - at >= LEAST_CHUNK or hit == end - start:
                cuts.append(at := hit)
        found.append(cuts)
        first, start = last, end
    return found


def _digests(text: bytes, cuts: list[int]) -> list[bytes]:
    return [xxhash.xxh3_128_digest(text[a:b]) for a, b in zip([0, *cuts], cuts)]


def seams(coder: Codec, text: bytes, cuts: list[int], ids: np.ndarray) -> list[list[int]]:
    """Stretches around the seams of a text: grown by sure borders until both ends are token borders."""
    if len(cuts) < 2:
        return []
    edges = set(np.cumsum(coder.lengths[ids]).tolist())
    spans: list[list[int]] = []
    for seam in cuts[:-1]:
        low, high = _border_before(text, seam), _border_after(text, seam)
        while low > 0 and low not in edges:
            low = _border_before(text, low)
        while high < len(text) and high not in edges:
            high = _border_after(text, high)
        if spans and low <= spans[-1][1]:
            spans[-1][1] = max(high, spans[-1][1])
        else:
            spans.append([low, high])
    return spans


def stitch(coder: Codec, ids: np.ndarray, spans: list[list[int]], anew: list[bytes]) -> np.ndarray:
    """The ids with every stretch replaced by its own ids."""
    if not spans:
        return ids
    ends = np.concatenate([[0], np.cumsum(coder.lengths[ids])])
    at = np.searchsorted(ends, np.array(spans)).tolist()  # tokens up to both ends of each stretch
    out, done = [], 0
    for (low, high), fresh in zip(at, anew):
        out += [ids[done:low], coder.ids(fresh)]
        done = high
    return np.concatenate([*out, ids[done:]])


def assembled(coder: Codec, plans: list[tuple[bytes, list[int], list[bytes]]]) -> list[np.ndarray]:
    """Ids of whole texts from (text, cuts, ids of the chunks): seams of all texts repaired together."""
    joined = [coder.ids(b"".join(parts)) for _, _, parts in plans]
    spans = [seams(coder, text, cuts, ids) for (text, cuts, _), ids in zip(plans, joined)]
    pieces = [text[a:b].decode() for (text, _, _), own in zip(plans, spans) for a, b in own]
    fresh = iter(coder.encode(pieces))
    return [
        stitch(coder, ids, own, [next(fresh) for _ in own]) for ids, own in zip(joined, spans)
    ]


def _border_before(text: bytes, at: int) -> int:
    """The last sure border before ``at``, else 0."""
    while at > 0:
        at = max(text.rfind(b" ", 0, at), text.rfind(b"\n", 0, at))
        if at > 0 and 0x21 <= text[at - 1] <= 0x7E:
            return at
    return 0


def _border_after(text: bytes, at: int) -> int:
    """The first sure border after ``at``, else the text's length."""
    found = _BORDER.search(text, at + 1)
    return found.start() if found else len(text)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, key): rows of equal id and text share a key, all others have their own."""
    texts = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    return texts.withColumn("key", F.xxhash64("doc_id", "text"))


_Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _prepared(docs: DataFrame, vocabulary: str, id_col: str, text_col: str) -> tuple[DataFrame, _Step]:
    """Documents beside the ids of their shared chunks, and the step that makes their ids.

    The texts are shuffled once, by a hash of their row; chunk digests take 16 bytes a chunk, and
    the ids of a shared chunk are carried to each document that holds it.
    """
    texts = _keyed(docs, id_col, text_col)
    kind = dict(texts.dtypes)["doc_id"]

    def list_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            raw = [text.encode() for text in batch.column(1).to_pylist()]
            keys, found = [], []
            for key, text, cuts in zip(batch.column(0).to_pylist(), raw, cut_points(raw)):
                own = list(dict.fromkeys(_digests(text, cuts)))
                keys += [key] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(found, pa.binary())], ["key", "chunk"]
            )

    places = stored(
        texts.select("key", "text").mapInArrow(list_chunks, "key long, chunk binary"), "chunks"
    )
    shared = (
        places.groupBy("chunk")
        .agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key"))
        .where("n > 1")
    )
    wanted = shared.groupBy("key").agg(F.collect_list("chunk").alias("chunks"))

    def encode_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary)
        for batch in slices(batches, "text"):
            raw = [text.encode() for text in batch.column(1).to_pylist()]
            found: dict[bytes, str] = {}
            for text, cuts, asked in zip(raw, cut_points(raw), batch.column(2).to_pylist()):
                asked = set(asked)
                for digest, a, b in zip(_digests(text, cuts), [0, *cuts], cuts):
                    if digest in asked:
                        found[digest] = text[a:b].decode()
            coded = coder.encode(list(found.values()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()), pa.array(coded, pa.binary())], ["chunk", "ids"]
            )

    # Both joins ask for the same columns of ``texts``, so that they share one shuffle of the texts.
    # Rows of equal id and text share a key and may each have encoded their chunks.
    once = (
        texts.join(wanted, "key")
        .select("doc_id", "text", "chunks")
        .mapInArrow(encode_shared, "chunk binary, ids binary")
        .dropDuplicates(["chunk"])
    )
    brought = (
        places.join(once, "chunk")
        .groupBy("key")
        .agg(F.collect_set(F.struct("chunk", "ids")).alias("given"))  # rows may repeat a key
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary)
        for batch in slices(batches, "text"):
            raw = [text.encode() for text in batch.column(1).to_pylist()]
            plans, lacking = [], []
            for text, cuts, given in zip(raw, cut_points(raw), batch.column(2).to_pylist()):
                have = {pair["chunk"]: pair["ids"] for pair in given or ()}
                parts: list = [have.get(digest) for digest in _digests(text, cuts)] if have else [None] * len(cuts)
                for i, (a, b) in enumerate(zip([0, *cuts], cuts)):
                    if parts[i] is None:
                        lacking.append((parts, i, text[a:b].decode()))
                plans.append((text, cuts, parts))
            for (parts, i, _), coded in zip(lacking, coder.encode([piece for _, _, piece in lacking])):
                parts[i] = coded
            made = assembled(coder, plans)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(ids) for ids in made], pa.int64()),
                    pa.array([ids.astype(coder.dtype).tobytes() for ids in made], pa.binary()),
                ],
                ["doc_id", "n_tokens", "ids"],
            )

    return texts.join(brought, "key", "left").select("doc_id", "text", "given"), finish


def encode(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_tokens, ids): ids in little-endian bytes of the codec's width."""
    whole, finish = _prepared(docs, vocabulary, id_col, text_col)
    kind = dict(whole.dtypes)["doc_id"]
    return whole.mapInArrow(finish, f"doc_id {kind}, n_tokens long, ids binary")


def _decoding(vocabulary: str) -> _Step:
    names = ["doc_id", "n_tokens", "ids", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary)
        for batch in slices(batches, "ids", 2 << 20):
            texts = [coder.decode(coder.ids(x)).decode() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names)

    return run


def decode(coded: DataFrame, vocabulary: str) -> DataFrame:
    """Add ``text``, what the ids stand for."""
    kind = dict(coded.dtypes)["doc_id"]
    return coded.mapInArrow(
        _decoding(vocabulary), f"doc_id {kind}, n_tokens long, ids binary, text string"
    )


_DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digesting(vocabulary: str) -> _Step:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary)
        for batch in slices(batches, "ids", 2 << 20):
            ids = map(coder.ids, batch.column(2).to_pylist())
            found = [hashlib.sha256(coder.listed(x)).hexdigest() for x in ids]
            back = [hashlib.sha256(x.encode()).hexdigest() for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(back, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def digests(decoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of decoded rows."""
    kind = dict(decoded.dtypes)["doc_id"]
    return decoded.mapInArrow(_digesting(vocabulary), f"doc_id {kind}, {_DIGESTS}")


def round_trip(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The digests of encoded and decoded documents.

    A Python worker takes each batch through all three steps, so neither ids nor decoded texts
    travel between steps, and a task needs one worker.
    """
    whole, finish = _prepared(docs, vocabulary, id_col, text_col)
    decoding, digesting = _decoding(vocabulary), _digesting(vocabulary)
    kind = dict(whole.dtypes)["doc_id"]
    return whole.mapInArrow(
        lambda batches: digesting(decoding(finish(batches))), f"doc_id {kind}, {_DIGESTS}"
    )
