"""SentencePiece encoding by unigram Viterbi over a double-array trie, and decoding.

White space becomes the marker U+2581, one is put in front, the segmentation with the largest sum of log scores is found,
and characters that no piece covers fall back to bytes. No piece of a vocabulary reaches across a stretch's end where
white space or a line break begins, so stretches are segmented alone and those that recur in a task are looked up.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.llm.common import table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Fixed values of the model file's format: numbers of fields, and types of pieces.
PIECES, PIECE, SCORE, TYPE = 1, 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: What an uncovered character costs below the least score of a piece.
PENALTY = 10.0
#: Stretches that a task remembers, and the longest one that it does.
REMEMBERED, LONGEST = 200_000, 48


def fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Fields of one message in the protocol-buffer wire format."""
    at = 0

    def varint() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


def read_pieces(model: bytes) -> list[tuple[str, float, int]]:
    """Piece, score and type by id."""
    out = []
    for number, body in fields(model):
        if number == PIECES:
            f = dict(fields(body))
            out.append((f[PIECE].decode(), struct.unpack("<f", f[SCORE])[0] if SCORE in f else 0.0, f.get(TYPE, NORMAL)))
    return out


def double_array(keys: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value of a trie over bytes: state s goes on byte c to base[s] + c if check there is s."""
    children: list[dict[int, int]] = [{}]
    ends: dict[int, int] = {}
    for key, value in keys:
        node = 0
        for c in key:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
            node = children[node][c]
        ends[node] = value
    size = 256 * len(children) + 1024
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    used = bytearray(size)
    used[0] = 1
    place, free, top, todo = {0: 0}, 256, 256, [0]  # no state below 256 but the root, so any byte reaches a free one
    while todo:
        node = todo.pop()
        s = place[node]
        value[s] = ends.get(node, -1)
        if kids := sorted(children[node]):
            while used[free]:
                free += 1
            b = (free if len(kids) == 1 else max(free, top - 96)) - kids[0]
            while any(used[b + c] for c in kids):
                b += 1
            base[s] = b
            top = max(top, b + kids[-1])
            for c in kids:
                used[b + c] = 1
                check[b + c] = s
                place[children[node][c]] = b + c
                todo.append(children[node][c])
    last = top + 257
    return base[:last].copy(), check[:last].copy(), value[:last].copy()


@dataclass(frozen=True)
class Codec:
    """A vocabulary ready for use; some megabytes whatever the input, and sent with the job."""

    pieces: list[bytes]
    scores: np.ndarray
    byte_ids: list[int]
    unknown: int
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    least: float
    stretches: str

    @staticmethod
    def load(spark: SparkSession, path: str) -> Codec:
        """From a model file in any store that Spark reads."""
        return Codec.of(bytes(spark.read.format("binaryFile").load(path if ":" in path else f"file://{path}").select("content").first()[0]))

    @staticmethod
    def of(model: bytes) -> Codec:
        rows = read_pieces(model)
        byte_ids = [-1] * 256
        for i, (p, _, kind) in enumerate(rows):
            if kind == BYTE:
                byte_ids[int(p[3:5], 16)] = i
        plain = [(p.encode(), i) for i, (p, _, kind) in enumerate(rows) if kind in (NORMAL, USER)]
        inner = any(MARK in p.lstrip(MARK) for p, _, kind in rows if kind in (NORMAL, USER))
        breaks = any("\n" in p for p, _, kind in rows if kind in (NORMAL, USER))
        stretches = r"(?s).+" if inner or breaks else f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+"
        names = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.encode() if kind in (NORMAL, USER) else b"" if kind == CONTROL else " ⁇ ".encode() for p, _, kind in rows]
        unknown = next(i for i, r in enumerate(rows) if r[2] == UNKNOWN)
        scores = [s for _, s, kind in rows if kind == NORMAL]
        return Codec(names, np.array([s for _, s, _ in rows]), byte_ids, unknown, *double_array(plain), min(scores), stretches)

    def segmenter(self):
        """A function from a stretch to its ids; the arrays as lists, which single steps read faster."""
        base, check, value, scores = self.base.tolist(), self.check.tolist(), self.value.tolist(), self.scores.tolist()
        cost, unknown, byte_ids, states = self.least - PENALTY, self.unknown, self.byte_ids, len(self.base)

        def segment(stretch: str) -> list[int]:
            body = stretch.encode("utf-8", "replace")
            n = len(body)
            best, back, piece = [-1e300] * (n + 1), [0] * (n + 1), [0] * (n + 1)
            best[0] = 0.0
            at = 0
            while at < n:
                lead = body[at]
                wide = 1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4
                so_far, s, covered = best[at], 0, False
                for k in range(at, n):
                    t = base[s] + body[k]
                    if t >= states or check[t] != s:
                        break
                    s = t
                    if (v := value[s]) >= 0:
                        covered = covered or k + 1 == at + wide
                        if (total := so_far + scores[v]) > best[k + 1]:
                            best[k + 1], back[k + 1], piece[k + 1] = total, at, v
                if not covered and so_far + cost > best[at + wide]:
                    best[at + wide], back[at + wide], piece[at + wide] = so_far + cost, at, unknown
                at += wide
            out: list[int] = []
            while n:
                if piece[n] != unknown:
                    out.append(piece[n])
                elif min(byte_ids) >= 0:
                    out.extend(byte_ids[b] for b in reversed(body[back[n] : n]))
                elif not out or out[-1] != unknown:  # neighbours without bytes are one unknown piece
                    out.append(unknown)
                n = back[n]
            return out[::-1]

        return segment

    def encoder(self):
        """A function from a text to its ids as little-endian 32-bit numbers."""
        segment, find = self.segmenter(), re.compile(self.stretches).findall

        class Known(dict):
            def __missing__(self, stretch: str) -> bytes:
                found = np.array(segment(stretch), "<i4").tobytes()
                if len(stretch) <= LONGEST:
                    if len(self) >= REMEMBERED:
                        self.clear()
                    self[stretch] = found
                return found

        known = Known()
        return lambda text: b"".join([known[x] for x in find(MARK + text.replace(" ", MARK))]) if text else b""

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, byte pieces put together, markers as blanks without the one in front."""
        pieces = self.pieces
        text = b"".join([pieces[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


def encoded(df: DataFrame, codec: Codec, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the ids of a text column; none for a null or empty text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = codec.encoder()
        for b in batches:
            found = [encode(t or "") for t in b.to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(f) // 4 for f in found])]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<i4")))

    return df.withColumn(ids, arrow_iterator(run, "array<int>")(F.col(text)))


def decoded(df: DataFrame, codec: Codec, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of a column of ids; null as the empty text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([codec.decode(b[i].values.to_numpy().tolist() if b[i].is_valid else []) for i in range(len(b))], pa.string())

    return df.withColumn(text, arrow_iterator(run, "string")(F.col(ids)))


def arrow_iterator(run, kind: str):
    """An Arrow UDF that is evaluated once, however often its column is read."""
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind).asNondeterministic()


def codec_report(docs: DataFrame, codec: Codec) -> DataFrame:
    """One row per row of docs: doc_id, n_ids, n_byte_ids, ids_sha256 (of the ids joined by blanks), round_trip.

    round_trip tells whether decoding the ids gives the text again. It does for any text without U+2581 itself, which the
    scheme writes as it writes a blank. Null counts as empty. Repeated rows are encoded alike; other columns aren't read.
    """
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = decoded(encoded(df, codec), codec)
    low, high = min(codec.byte_ids), max(codec.byte_ids)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        F.size(F.filter("ids", lambda i: i.between(low, high))).cast("long").alias("n_byte_ids"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        (F.col("decoded") == F.col("text")).alias("round_trip"),
    )


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return codec_report(table(spark, sf_dir, "documents"), Codec.load(spark, VOCABULARY))
