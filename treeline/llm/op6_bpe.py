"""Byte-level BPE encoding and decoding by forced boundaries.

A pair of adjacent bytes that occurs inside no token of the vocabulary can never be merged over, so the text may be cut
there for certain. Cuts are found for a whole batch at once by a table of 65,536 flags. The pre-tokenizer's pattern looks
at context, so only those cuts are used that it cannot notice: before ASCII white space that follows a character which is
none and between ASCII letters, digits and marks (a pre-token always starts there, but for letters after an apostrophe),
between two ASCII letters (both halves match the same alternative), and before an ASCII mark other than the apostrophe
after a character beyond ASCII that is no white space. The fragments are encoded independently, repeated ones from a bounded memo, and their ids concatenated. Texts are first cut
around the strings of added tokens, as the tokenizers library does.

Scale: a narrow map over the texts; nothing is shuffled, memory is bounded by a batch and the memo.

Defined cases: null counts as the empty text, which has no tokens; long texts are encoded whole; repeated rows and extra
columns pass; an empty table gives an empty result. A text that holds no cut is one fragment.
"""

from __future__ import annotations

import hashlib
import json
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from treeline.llm.common import in_python, table

#: Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of fragments a task remembers, about; when full, it starts anew.
MEMO = 32 << 20
#: Bytes cut at once, whose fragments take some forty times as much; a longer text is taken whole.
BLOCK = 1 << 18


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write bytes as printable characters: these stand for themselves, the rest for 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ForcedBoundaryBPE:
    """Encoder and decoder of a byte-level BPE vocabulary of the tokenizers library."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbol = _byte_of_symbol()
        self.bytes_of = {i: bytes(symbol[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        joined = np.zeros(1 << 16, dtype=bool)
        for token in self.bytes_of.values():
            b = np.frombuffer(token, dtype=np.uint8).astype(np.int32)
            joined[b[:-1] * 256 + b[1:]] = True
        self.added = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        plain = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not t["normalized"] for t in spec.get("added_tokens", []))
        if not plain or spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only plain byte-level vocabularies are supported")
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        if [spec["model"]["vocab"][a + b] for a, b in merges] != sorted(spec["model"]["vocab"][a + b] for a, b in merges):
            raise ValueError("ids must follow the order of merges")
        self.fragment = tiktoken.Encoding("fragments", pat_str=PATTERN, mergeable_ranks={t: i for i, t in self.bytes_of.items()}, special_tokens={}).encode_ordinary
        self.bytes_of |= {i: t for t, i in self.added.items()}
        letter = np.zeros(256, dtype=bool)
        letter[65:91] = letter[97:123] = True
        white = np.zeros(256, dtype=bool)
        white[[9, 10, 11, 12, 13, 32]] = True
        ink = np.zeros(256, dtype=bool)
        ink[33:127] = True
        # bytes that end no white-space character of Unicode's, if they are not ASCII
        ends = {0x80, 0x81, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF}
        ink[[b for b in range(128, 192) if b not in ends]] = True
        digit = np.zeros(256, dtype=bool)
        digit[48:58] = True
        mark = np.zeros(256, dtype=bool)
        mark[33:127] = True
        mark &= ~(letter | digit)
        seen = (letter[:, None] & letter[None, :]) | (ink[:, None] & white[None, :])
        kinds = np.select([letter, digit, mark], [1, 2, 3], 0)
        turn = (kinds[:, None] != kinds[None, :]) & (kinds[:, None] > 0) & (kinds[None, :] > 0)
        turn[39, letter] = False
        late = (ink & (kinds == 0))[:, None] & mark[None, :]
        late[:, 39] = False
        seen |= turn | late
        self.cut = seen.ravel() & ~joined
        self.memo: dict[bytes, bytes] = {}
        self.held = 0

    def _fragments(self, data: np.ndarray, raw: bytes, starts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Fragments of adjacent texts that begin at starts, and the index of each text's first one."""
        pair = data[:-1].astype(np.uint16) << 8 | data[1:]
        flags = np.zeros(len(data), dtype=bool)
        flags[1:] = self.cut[pair]
        flags[starts] = True
        bounds = np.flatnonzero(flags)
        ends = np.append(bounds[1:], len(data)).tolist()
        return [raw[a:b] for a, b in zip(bounds.tolist(), ends)], np.searchsorted(bounds, starts)

    def forget(self) -> None:
        self.memo, self.held = {}, 0

    def _learn(self, fragments: set[bytes]) -> None:
        missing = [x for x in fragments if x not in self.memo]
        if self.held > MEMO:
            self.forget()
            missing = list(fragments)
        for x in missing:
            ids = self.fragment(x.decode())
            self.memo[x] = struct.pack(f"<{len(ids)}I", *ids)
            self.held += 200 + len(x) + 4 * len(ids)

    def _encode_block(self, raw: bytes, starts: np.ndarray) -> list[bytes]:
        fragments, first = self._fragments(np.frombuffer(raw, dtype=np.uint8), raw, starts)
        self._learn(set(fragments))
        ids = list(map(self.memo.__getitem__, fragments))
        bounds = [*first.tolist(), len(ids)]
        return [b"".join(ids[a:b]) for a, b in zip(bounds, bounds[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        pieces: list[tuple[int, bytes]] = []  # (text, bytes between added tokens)
        out: list[list] = [[] for _ in texts]
        for i, text in enumerate(texts):
            rest = [text.encode()]
            for token, number in self.added.items():
                split = []
                for x in rest:
                    if isinstance(x, int):
                        split.append(x)
                        continue
                    for k, y in enumerate(x.split(token)):
                        split.extend([number] * (k > 0))
                        split.append(y)
                rest = split
            for x in rest:
                if isinstance(x, int):
                    out[i].append(np.array([x], dtype="<u4").tobytes())
                elif x:
                    pieces.append((i, x))
                    out[i].append(len(pieces) - 1)
        done: list[bytes] = []
        block, size = [], 0
        for k, (_, x) in enumerate(pieces):
            block.append(x)
            size += len(x)
            if size >= BLOCK or k == len(pieces) - 1:
                starts = np.cumsum([0, *map(len, block[:-1])])
                done += self._encode_block(b"".join(block), starts)
                block, size = [], 0
        return [b"".join(done[x] if isinstance(x, int) else x for x in parts) for parts in out]

    def decode(self, ids: bytes) -> str:
        """The text of little-endian ids; special tokens stay."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


_ENCODERS: dict[str, ForcedBoundaryBPE] = {}


def encoder(path: str) -> ForcedBoundaryBPE:
    if path not in _ENCODERS:
        _ENCODERS[path] = ForcedBoundaryBPE(path)
    return _ENCODERS[path]


#: Rows worked on at once.
STEP = 256


def encode_documents(docs: DataFrame, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row, and with_ids the ids themselves (binary, little-endian)."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        bpe = encoder(path)
        try:
            for whole in batches:
                for i in range(0, whole.num_rows, STEP):
                    batch = whole.slice(i, STEP)
                    ids = bpe.encode([x or "" for x in batch.column("text").to_pylist()])
                    columns = [
                        batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids]),
                    ]
                    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, names=names + ["ids"] * with_ids)
        finally:
            bpe.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_python(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
