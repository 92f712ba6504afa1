"""Exact BPE encoding by backtracking, and decoding by an offset table.

The encoder finds, for every position of a word, the longest vocabulary entry that starts there
(one Aho-Corasick pass), and then walks the word left to right. A token may follow its
predecessor only if the two are *compatible*: undoing their merges around the border must never
reveal a merge that plain BPE would have made across it earlier. Where no shorter token fits, the
walk steps back over the last token and marks the position as a dead end, so no position is tried
twice and the time is linear in the length of the word. The result is that of the merge-by-rank
procedure.

Edge cases: a null text is the empty text and has no tokens; two rows with the same text, or the
same id, each give a row; columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorvia.llm.common import ChunkTable, id_and_text, id_ddl, map_arrow, quiet_gc, texts_of

#: White space as in Unicode's White_Space property; Python's own notion also has U+001C to U+001F.
SPACE = r"\t-\r \x85\xa0  -     　"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
ODD = regex.compile(r"[\x1c-\x1f]")
END = 0x1000  # added to the last character of a word, which the vocabulary marks by its suffix


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in chars:
            chars[b] = chr(extra)
            extra += 1
    return [chars[b] for b in range(256)]


BYTE_TO_CHAR = {b: c for b, c in enumerate(_byte_chars())}


class Vocabulary:
    """Tables of a word-level BPE vocabulary with word ends, read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        size = max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])], default=-1) + 1
        # rank: entries that no merge makes come first; a token's rank is the order of its merge
        self.split_left, self.split_right, rank = list(range(size)), list(range(size)), [0] * size
        self.pairs: dict[tuple[int, int], int] = {}
        made = 0
        for left, right in merges:
            token = vocab[left + right]
            a, b = vocab[left], vocab[right]
            self.pairs[a, b] = token
            if rank[token] == 0:
                made += 1
                rank[token] = made
                self.split_left[token], self.split_right[token] = a, b
        self.rank = rank
        self.key_id: dict[str, int] = {}
        self.length = [0] * size
        for text, token in vocab.items():
            key = self._key(text)
            self.key_id[key] = token
            self.length[token] = len(key)
        self.automaton = ahocorasick.Automaton()
        self.prefix = [-1] * size
        for key, token in self.key_id.items():
            self.automaton.add_word(key, token)
            for n in range(len(key) - 1, 0, -1):
                if (shorter := self.key_id.get(key[:n])) is not None:
                    self.prefix[token] = shorter
                    break
        self.automaton.make_automaton()
        # decoding: one blob of all entries and the offset of each
        names = [""] * size
        for text, token in vocab.items():
            names[token] = text
        self.special: dict[str, int] = {}
        for a in spec["added_tokens"]:
            names[a["id"]] = a["content"]
            self.special[a["content"]] = a["id"]
        parts = [n.encode() for n in names]
        self.blob = b"".join(parts)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
        at = self.offsets.tolist()
        self._pieces = [self.blob[s:e] for s, e in zip(at, at[1:])]
        self.specials = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.compatible = ChunkTable(lambda pair: self._compatible(pair >> 32, pair & 0xFFFFFFFF), 500_000, longest=0)
        self.word_ids = ChunkTable(self._word, 300_000)
        self.chunk_ids = ChunkTable(self._chunk, 300_000)

    def _key(self, text: str) -> str:
        if self.suffix and text.endswith(self.suffix) and len(text) > len(self.suffix):
            body = text[: -len(self.suffix)]
            return body[:-1] + chr(ord(body[-1]) + END)
        return text

    def _compatible(self, left: int, right: int) -> bool:
        """Whether plain BPE keeps the border between these two tokens."""
        pairs, rank, limit = self.pairs, self.rank, 1 << 60
        while True:
            merged = pairs.get((left, right))
            if merged is not None and rank[merged] < limit:
                return False
            # undo the later of the two merges, as only what was there before it can have merged
            if rank[left] > rank[right]:
                limit = rank[left]
                left = self.split_right[left]
            else:
                if rank[right] == 0:
                    return True
                limit = rank[right] + 1
                right = self.split_left[right]

    def _word(self, word: str) -> bytes:
        """Ids of one word: letters, one digit, or a run of other signs."""
        mapped = word.encode("utf-8").decode("latin-1").translate(BYTE_TO_CHAR)
        key = mapped[:-1] + chr(ord(mapped[-1]) + END) if self.suffix else mapped
        if (whole := self.key_id.get(key)) is not None:
            return whole.to_bytes(4, "little")
        n, length, compatible, matches = len(key), self.length, self.compatible, self.automaton.iter_long
        longest = [-1] * (n + 1)  # of each position that a token has ended at
        for end, token in matches(key):
            longest[end - length[token] + 1] = token
        alive = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + length[token]
                if alive[end] and (last < 0 or compatible[last << 32 | token]):
                    out.append(token)
                    if end < n and longest[end] < 0:
                        longest[end] = next(matches(key, end))[1]
                    at, token = end, longest[end]
                    break
                token = self.prefix[token]
            else:
                if not out:
                    raise ValueError(f"the vocabulary can't spell {word!r}")
                alive[at] = 0
                token = out.pop()
                at -= length[token]
        return np.array(out, dtype="<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.word_ids.__getitem__, WORDS.findall(chunk)))

    def _plain(self, text: str) -> bytes:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # lower-casing here is by single characters: no final sigma
            text = text.replace("Σ", "σ")
        text = text.lower()
        if ODD.search(text):
            return self._chunk(text)
        return b"".join(map(self.chunk_ids.__getitem__, text.split()))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if self.specials is None or "<|" not in text:
            return self._plain(text)
        out, at = [], 0
        for found in self.specials.finditer(text):
            out += [self._plain(text[at : found.start()]), self.special[found.group()].to_bytes(4, "little")]
            at = found.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> bytes:
        """The vocabulary entries of the ids, joined by a space, in UTF-8."""
        return b" ".join(map(self._pieces.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, token_ids array<int>`` of every whole text."""
    path = path or default_path()

    def run(batch: pa.RecordBatch):
        quiet_gc()
        v = vocabulary(path)
        ids = [np.frombuffer(v.encode(t), dtype="<u4").astype(np.int32) for t in texts_of(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "token_ids"])

    return map_arrow(id_and_text(docs, id_col, text_col), run, f"doc_id {id_ddl(docs, id_col)}, token_ids array<int>")


def decode_documents(tokens: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """``doc_id, text``: the inverse of ``encode_documents`` up to normalisation; null ids: the empty text."""
    path = path or default_path()

    def run(batch: pa.RecordBatch):
        v = vocabulary(path)
        texts = [v.decode(np.asarray(x or [], dtype="<u4").tobytes()).decode() for x in batch.column("token_ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_arrow(tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("token_ids")), run, f"doc_id {id_ddl(tokens, id_col)}, text string")


def encoding_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encode, decode what was encoded, digest both."""
    path = path or default_path()

    def run(batch: pa.RecordBatch):
        quiet_gc()
        v, counts, ids_sha, text_sha = vocabulary(path), [], [], []
        for text in texts_of(batch):
            ids = v.encode(text)
            counts.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            text_sha.append(hashlib.sha256(v.decode(ids)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return map_arrow(id_and_text(docs, id_col, text_col), run, f"doc_id {id_ddl(docs, id_col)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
