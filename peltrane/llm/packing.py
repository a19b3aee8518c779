"""Packing by order-preserving dynamic programming with a monotone queue.

Documents keep their order (that of the input's partitions; no shuffle). Their tokens, each document's ending with an end
id, form one stream for each partition. Windows of the stream become sequences of at most `limit` tokens; a window of n
tokens is padded to the limit unless n is a power of two. A cut costs nothing after a document, `sentence_cost` after a
token that ends a sentence or line, and `free_cost` elsewhere (places every `stride` tokens inside long sentences). With
positions p, the best cost at place j is
  best[j] = cut[j] + sequence_cost + min( limit - p[j] + min over p[j] - p[i] <= limit of (best[i] + p[i]),
                                          min over powers of two of best[i] with p[j] - p[i] = 2^k ),
the first minimum from a monotone queue, so each place enters and leaves it once. The stream is solved in chunks of some
hundred thousand tokens; a chunk's last window goes on into the next chunk, so memory doesn't grow with the partition. What is
left at a partition's end is cut into powers of two if that costs less than its padding.

Token ids are those of the byte-level BPE file. Texts of Latin letters, digits and punctuation only go through tiktoken
with the same vocabulary and pattern (equal ids, tested); any other text, any that spells a special token, and any with a run of
20,000 blanks or non-blanks goes through the tokenizers library itself. The vocabulary files are read on the driver and broadcast (about 2.4 MB, fixed).

A null or empty text is the end id alone. Very long texts are cut over sequences. Repeated rows and null ids have pieces of
their own. Columns other than the two named are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import deque
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, END_ID = 2048, 1
SENTENCE_COST, FREE_COST, SEQUENCE_COST, STRIDE = 4, 16, 1, 64
CHUNK_TOKENS = 400_000
SCHEMA = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Up to here (Latin letters, accents) both libraries class every character alike.
PLAIN = re.compile("[\\x00-ɏ]*\\Z")
#: One piece of the pattern this long (a run of blanks, letters, digits or others) is left to the tokenizers library: tiktoken's
#: pattern recurses on long runs and ends the process at about a million blanks.
LONG_RUN = 20_000
LONG = re.compile(rf"\s{{{LONG_RUN}}}|\S{{{LONG_RUN}}}")


def tokenizer_files(json_path: str | None = None, ranks_path: str | None = None) -> tuple[str, bytes, str]:
    """The tokenizers file, the same vocabulary as ranks, and the pattern that splits words."""
    import public_tokenizers as P

    return (
        Path(json_path or P.path("byte_bpe_50k.json")).read_text(encoding="utf-8"),
        Path(ranks_path or P.path("byte_bpe_50k.tiktoken")).read_bytes(),
        P.PATTERN,
    )


class Encoder:
    """Texts to ids, and which ids end a sentence."""

    def __init__(self, files: tuple[str, bytes, str]):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        text, ranks, pattern = files
        self.slow = Tokenizer.from_str(text)
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        size = max(self.slow.get_vocab_size(), max(table.values()) + 1, END_ID + 1)
        self.ends = np.zeros(size, dtype=bool)
        for token, k in table.items():
            self.ends[k] = token.endswith((b".", b"!", b"?", b"\n"))

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.array([END_ID], dtype="<u4")
        if PLAIN.match(text) and (len(text) < LONG_RUN or not LONG.search(text)) and not any(s in text for s in self.special):
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.slow.encode(text, add_special_tokens=False).ids
        ids.append(END_ID)
        return np.array(ids, dtype="<u4")


def cut_places(lengths: list[int], ends: np.ndarray, *, stride: int = STRIDE, sentence_cost: int = SENTENCE_COST, free_cost: int = FREE_COST) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the stream may be cut, 0 and its end included, and what a cut costs there.

    lengths: tokens of each document; ends: for each token, whether a sentence ends with it.
    """
    total = int(sum(lengths))
    cost = np.full(total + 1, -1, dtype=np.int64)
    cost[1:][ends] = sentence_cost
    cost[np.concatenate(([0], np.cumsum(lengths)))] = 0
    places = np.flatnonzero(cost >= 0)
    gaps = np.diff(places)
    if (wide := np.flatnonzero(gaps > stride)).size:
        more = np.concatenate([np.arange(places[k] + stride, places[k + 1], stride) for k in wide])
        cost[more] = free_cost
        places = np.flatnonzero(cost >= 0)
    return places, cost[places]


def best_cuts(places: np.ndarray, cost: np.ndarray, limit: int = LIMIT, sequence_cost: int = SEQUENCE_COST) -> list[int]:
    """Indices into places where windows end, the last one included; of least total cost."""
    p, c = places.tolist(), cost.tolist()
    n = len(p)
    best, back = [0] * n, [0] * n
    where = {x: i for i, x in enumerate(p)}
    powers = [1 << k for k in range(limit.bit_length()) if 1 << k <= limit and 1 << k >= min(32, limit)]
    queue: deque[int] = deque([0])  # indices of rising best + position
    value = [0] * n
    for j in range(1, n):
        at = p[j]
        while p[queue[0]] < at - limit:
            queue.popleft()
        i = queue[0]
        low = value[i] + limit - at
        for w in powers:
            k = where.get(at - w)
            if k is not None and best[k] < low:
                low, i = best[k], k
        best[j], back[j] = low + c[j] + sequence_cost, i
        v = value[j] = best[j] + at
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def tail_lengths(n: int, limit: int = LIMIT, cost: int = FREE_COST + SEQUENCE_COST) -> list[int]:
    """A partition's last tokens: one padded sequence, or powers of two from the largest on."""
    bits = [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]
    return bits if (len(bits) - 1) * cost < limit - n else [n]


def pack_stream(batches, encode: Encoder, *, limit: int = LIMIT, chunk: int = CHUNK_TOKENS, first_id: int = 0, **costs):
    """(id, text) pairs to rows of SCHEMA, in order. The costs go to cut_places()."""
    held: list[list] = []  # [id, start in the document, ids, tokens of the document]
    count, sequence = 0, first_id

    def emit(windows: list[int]):
        """Gives the first sum(windows) of the held tokens to sequences."""
        nonlocal held, count, sequence
        k = 0
        for window in windows:
            offset = 0
            while offset < window:
                key, start, ids, whole = held[k]
                take = min(window - offset, len(ids))
                yield key, start, take, zlib.crc32(ids[:take].tobytes()), whole, sequence, offset
                offset += take
                if take == len(ids):
                    k += 1
                else:
                    held[k] = [key, start + take, ids[take:], whole]
            sequence += 1
        held = held[k:]
        count -= sum(windows)

    def solve(last: bool):
        lengths = [len(x[2]) for x in held]
        places, cost = cut_places(lengths, encode.ends[np.concatenate([x[2] for x in held])], **costs)
        cuts = places[best_cuts(places, cost, limit)]
        windows = np.diff(np.concatenate(([0], cuts))).tolist()
        if last and windows:
            windows[-1:] = tail_lengths(windows[-1], limit)
        return windows if last else windows[:-1]

    for key, text in batches:
        ids = encode(text)
        held.append([key, 0, ids, len(ids)])
        count += len(ids)
        if count >= chunk:
            yield from emit(solve(False))
    if held:
        yield from emit(solve(True))


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", files: tuple[str, bytes, str] | None = None, limit: int = LIMIT, chunk: int = CHUNK_TOKENS, **costs) -> DataFrame:
    """One row per piece: SCHEMA. Sequence ids are unique over the table; a sequence's offsets have no gaps."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(files or tokenizer_files())
    schema = SCHEMA.format(id=dict(rows.dtypes)["doc_id"])

    def run(batches):
        from pyspark import TaskContext

        encode = Encoder(shared.value)
        kind = None

        def pairs():
            nonlocal kind
            for b in batches:
                kind = b.schema.field(0).type
                ids = b.column(0).to_pylist()
                for i, key in enumerate(ids):
                    yield key, b.column(1)[i].as_py()

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        rows: list[tuple] = []

        def flush():
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], type=kind), *[pa.array(c, type=pa.int64()) for c in columns[1:]]], names=names)

        for row in pack_stream(pairs(), encode, limit=limit, chunk=chunk, first_id=TaskContext.get().partitionId() << 33, **costs):
            rows.append(row)
            if len(rows) >= 20_000:
                yield flush()
                rows.clear()
        if rows:
            yield flush()

    return rows.mapInArrow(run, schema)
