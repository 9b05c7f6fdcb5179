"""Token counts of whole texts with a public tokenizer, lengths only.

Texts come in Arrow batches and are encoded in groups of about the same number of bytes. Where the vocabulary drops white space,
texts are cut at ASCII spaces and line feeds, where no token can begin on one side and end on the other, so a
count is the sum over the pieces; a task remembers the counts of pieces it has met in a table of bounded size. Texts
(and pieces) over LONG characters are cut further, at boundaries that the tokenizer's kind makes safe:

- word vocabularies whose pattern takes each number character alone: beside ASCII digits;
- byte-level vocabularies: before a space between two other characters, which starts a token of its own;
- sentence pieces in whose vocabulary no piece holds a word mark inside: at a space between ASCII letters or digits.

A vocabulary for which that can't be read off its file gets whole texts.

Defined results: a null text counts as empty (0 bytes, 0 tokens); rows with equal ids are counted row
by row; an empty table gives an empty table; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces whose counts a task remembers; the table is emptied when it is full, which costs time only.
REMEMBERED = 400_000
#: Bytes of pieces in one call of the tokenizer, and of texts that are cut up at once.
GROUP_BYTES, TEXT_BYTES = 1 << 16, 1 << 20
#: Characters from which a text or piece is cut at safe boundaries.
LONG = 1 << 14


def tokenizer_path(name: str) -> str:
    """A path as it is; a bare name of a public tokenizer as its place on this machine."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass
class Encoder:
    """encode: strings to token counts; words: whether white space ends every token; cut: where long strings may be cut (what it matches is left out)."""

    encode: Callable[[list[str]], list[int]]
    words: bool
    cut: re.Pattern | None


def _steps(part: dict | None, inner: str) -> list[dict]:
    return (part.get(inner) or [part]) if part else []


def encoder(path: str) -> Encoder:
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        encode = lambda texts: [len(e.ids) for e in model.encode_batch(texts, add_special_tokens=False)]
        added = [t["content"] for t in spec.get("added_tokens") or []]
        whole = not any(re.search(r"[\s0-9]", t) for t in added)
        splits = [s for s in _steps(spec.get("pre_tokenizer"), "pretokenizers") if s.get("type") == "Split"]
        # White space is dropped by the pre-tokenizer if its pattern keeps pieces of other characters alone.
        words = whole and any(s.get("behavior") == "Removed" and s.get("invert") for s in splits)
        if words:
            patterns = [(s.get("pattern") or {}).get("Regex", "") for s in splits]
            alone = any(r"[\p{N}]" in p.split("|") for p in patterns)
            return Encoder(encode, True, re.compile("(?<=[0-9])|(?=[0-9])") if alone else None)
        levels = [s for s in _steps(spec.get("pre_tokenizer"), "pretokenizers") if s.get("type") == "ByteLevel"]
        plain = whole and len(levels) == 1 and not splits and levels[0].get("use_regex", True) and not levels[0].get("add_prefix_space") and not spec.get("normalizer")
        return Encoder(encode, False, re.compile(r"(?<=[0-9A-Za-z])(?= [0-9A-Za-z])") if plain else None)
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        encode = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
        mark = "▁"
        inside = any(mark in model.id_to_piece(i).lstrip(mark) for i in range(model.get_piece_size()))
        same = model.encode("a b") == model.encode("a") + model.encode("b")
        return Encoder(encode, False, re.compile("(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])") if same and not inside else None)
    raise ValueError(f"no tokenizer library for {path}")


def n_bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def by_bytes(pieces: Iterable[str], most: int = GROUP_BYTES) -> Iterator[list[str]]:
    """Groups of pieces with up to `most` bytes; a longer piece is a group of its own."""
    group, size = [], 0
    for piece in pieces:
        n = n_bytes(piece)
        if group and size + n > most:
            yield group
            group, size = [], 0
        group.append(piece)
        size += n
    if group:
        yield group


def cut_up(text: str, cut: re.Pattern | None, long: int = LONG) -> list[str]:
    """Stretches of a text of about `long` characters, cut where `cut` matches."""
    if cut is None or len(text) <= long:
        return [text]
    parts, at = [], 0
    while (m := cut.search(text, at + long)) is not None and m.end() < len(text):
        parts.append(text[at : m.start()])
        at = m.end()
    return [*parts, text[at:]]


class Counter:
    """Counts tokens of texts by their pieces."""

    def __init__(self, path: str, remembered: int = REMEMBERED, long: int = LONG):
        self.by = encoder(tokenizer_path(path))
        self.known: dict[str, int] = {"": 0}
        self.remembered, self.long = remembered, long

    def _counts(self, texts: list[str]) -> list[int]:
        """Of each text, with long ones cut."""
        parts = [cut_up(t, self.by.cut, self.long) for t in texts]
        flat = iter([n for group in by_bytes(p for ps in parts for p in ps) for n in self.by.encode(group)])
        return [sum(next(flat) for _ in ps) for ps in parts]

    def count(self, texts: list[str]) -> list[int]:
        if not self.by.words:
            return [n for group in by_bytes(texts, TEXT_BYTES) for n in self._counts(group)]
        counts = []
        for group in by_bytes(texts, TEXT_BYTES):
            parts = [t.replace("\n", " ").split(" ") for t in group]
            new = set().union(*parts).difference(self.known)
            if new:
                if len(self.known) + len(new) > self.remembered:
                    self.known = {"": 0}
                    new = set().union(*parts) - {""}
                fresh = list(new)
                self.known.update(zip(fresh, self._counts(fresh), strict=True))
            look = self.known.__getitem__
            counts += [sum(map(look, p)) for p in parts]
        return counts


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row for each row of docs: id, n_bytes, n_tokens, over_limit (n_tokens > limit). path: a file, or the name of a public tokenizer, which each task finds on its machine."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = Counter(path)
        for batch in batches:
            n = pa.array(counter.count(batch.column(1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n], names=[id_col, "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col), text.alias("text_"), F.octet_length(text).cast("long").alias("n_bytes"))
    counted = read.mapInArrow(run, f"`{id_col}` {id_type}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
