"""Byte-pair encoding and decoding of whole texts.

A word's symbols form a doubly linked list. A priority queue holds the rank of each mergeable neighbour pair; an entry
whose symbols have changed since is skipped. Decoding concatenates the strings of the vocabulary.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.shared import documents

#: White space as Unicode defines it; Python's own notion adds U+001C to U+001F.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
MAX_FILE_BYTES = 32 << 20
#: Encoded runs, and as many words, that a Python worker keeps: about 250 MB.
KEEP = 400_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    letters |= {b: chr(0x100 + k) for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
    return [letters[b] for b in range(256)]


#: Number of tokens, ids joined by a space, decoded text.
Encoded = tuple[int, str, str]


class WordBpe:
    """The tokenizer of a word-level BPE file: NFC, white space dropped, lower case, words split by a pattern, byte letters
    and an end-of-word suffix. ``chunk`` gives what a run without white space encodes to; results are kept for up to
    ``keep`` runs and words at a time.
    """

    def __init__(self, file: bytes, keep: int = KEEP):
        spec = json.loads(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        merges = (m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"])
        # Symbols are numbers here: those of the vocabulary. A pair of them is one number too.
        self.ranks = {self.vocab[a] << 32 | self.vocab[b]: k for k, (a, b) in enumerate(merges)}
        names = {i: s for s, i in self.vocab.items()}
        self.merged = [0] * len(self.ranks)
        for pair, k in self.ranks.items():
            self.merged[k] = self.vocab[names[pair >> 32] + names[pair & 0xFFFFFFFF]]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.added.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"\s", SPACE))
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        letters = byte_letters()
        self.inner, self.final = [self.vocab[c] for c in letters], [self.vocab[c + self.suffix] for c in letters]
        if spec["decoder"] is not None:
            raise ValueError("only files without a decoder are supported")
        self.numbers = {i: str(i) for i in self.strings}
        self.keep = keep
        self.chunks = _Chunks(self)
        self.words: dict[str, Encoded] = {}
        self.odd_space = regex.compile(f"[^{SPACE}]+")

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge neighbours by rank, the leftmost first among equals, until no pair has a rank."""
        rank, merged, n = self.ranks.get, self.merged, len(symbols)
        # An entry of the queue is a rank and a place in one number.
        queue = [r << 32 | i for i in range(n - 1) if (r := rank(symbols[i] << 32 | symbols[i + 1])) is not None]
        if not queue:
            return symbols
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            entry = pop(queue)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if j < 0 or symbols[i] < 0 or rank(symbols[i] << 32 | symbols[j]) != entry >> 32:
                continue  # stale
            symbols[i], symbols[j] = (new := merged[entry >> 32]), -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank(new << 32 | symbols[k])) is not None:
                    push(queue, r << 32 | i)
            if (h := before[i]) >= 0 and (r := rank(symbols[h] << 32 | new)) is not None:
                push(queue, r << 32 | h)
        return [s for s in symbols if s >= 0]

    def word(self, word: str) -> Encoded:
        found = self.words.get(word)
        if found is None:
            data, inner = word.encode("utf-8", "surrogatepass"), self.inner
            symbols = [inner[b] for b in data]
            symbols[-1] = self.final[data[-1]]
            found = self.encoded(self.merge(symbols))
            if len(self.words) >= self.keep:
                drop_oldest(self.words)
            self.words[word] = found
        return found

    def encoded(self, ids: list[int]) -> Encoded:
        return len(ids), " ".join([self.numbers[i] for i in ids]), self.decode(ids)

    def plain(self, text: str) -> list[Encoded]:
        # Lower case letter by letter: a final sigma gets no form of its own.
        text = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return [self.word(w) for w in self.pattern.findall(text)]

    def chunk(self, run: str) -> Encoded:
        """What a run without white space encodes to."""
        if any(a in run for a in self.added):
            parts = []
            for k, part in enumerate(self.specials.split(run)):
                if k % 2:
                    parts.append(self.encoded([self.added[part]]))
                elif part:
                    parts += self.plain(part)
        else:
            parts = self.plain(run)
        return parts[0] if len(parts) == 1 else joined(parts)

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings with a space between, as a file without a decoder has it."""
        return " ".join([self.strings[i] for i in ids])

    def encode(self, text: str) -> Encoded:
        """Number of tokens, ids joined by a space, and decoded text of a whole text."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            runs = self.odd_space.findall(text)
        else:
            runs = text.split()
        chunks = self.chunks
        return joined([chunks[run] for run in runs])


def drop_oldest(held: dict) -> None:
    """Make room: the half that came first goes; what is common comes back at once."""
    for key in list(islice(held, (len(held) + 1) // 2)):
        del held[key]


class _Chunks(dict):
    """What runs encode to; a new one is encoded when it is asked for, and kept if it is short."""

    def __init__(self, bpe: WordBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, run: str) -> Encoded:
        found = self.bpe.chunk(run)
        if len(self) >= self.bpe.keep:
            drop_oldest(self)
        if len(run) <= 64:
            self[run] = found
        return found


def joined(parts: list[Encoded]) -> Encoded:
    if not parts:
        return 0, "", ""
    counts, ids, texts = zip(*parts, strict=True)
    if 0 in counts:
        ids, texts = [x for x in ids if x], [x for x, n in zip(texts, counts, strict=True) if n]
    return sum(counts), " ".join(ids), " ".join(texts)


@lru_cache(maxsize=1)
def word_bpe(file: bytes, keep: int) -> WordBpe:
    """The tokenizer of a file; a Python worker keeps it, and what it has encoded so far, from task to task."""
    return WordBpe(file, keep)


def read_vocabulary(path: str) -> bytes:
    """The file's bytes, read on the driver; its size is bounded, as tasks get a copy each."""
    with open(path, "rb") as f:
        file = f.read(MAX_FILE_BYTES + 1)
    if len(file) > MAX_FILE_BYTES:
        raise ValueError(f"{path} exceeds {MAX_FILE_BYTES} bytes")
    return file


def encode_documents(
    df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep: int = KEEP, hold: bool = True
) -> DataFrame:
    """One row per input row: id, n_tokens, ids, decoded.

    ids are decimal numbers joined by one space. Null and empty texts and texts of white space give no token and empty
    strings. Null ids and repeated rows are rows like any other; further columns are left out. Texts stay whole; there is
    no shuffle, and a lost task only encodes its own rows again. A task keeps up to ``keep`` encoded runs; with ``hold`` a
    Python worker passes them on to its next task, which is faster and takes memory from whatever runs beside or after it.
    """
    file = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = word_bpe(file.value, keep) if hold else WordBpe(file.value, keep)
        for pdf in batches:
            for k in range(0, len(pdf), 500):
                part = pdf.iloc[k : k + 500]
                rows = [bpe.encode(t or "") for t in part["text"]]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "n_tokens": [r[0] for r in rows], "ids": [r[1] for r in rows], "decoded": [r[2] for r in rows]})

    base = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    out = base.mapInPandas(run, f"id {kind}, n_tokens long, ids string, decoded string")
    return out.withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return encoded.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_documents(documents(spark, sf_dir), word_vocabulary()))
