"""Token counts of whole texts, in Arrow functions that return lengths only.

A text is cut at safe boundaries: before a space that stands between two characters that aren't white
space. The tokenizer's own pre-tokenizer always begins a piece there, and no special token holds a space,
so the counts of the segments add up to the text's. Texts that aren't cut have one segment. A task counts
each distinct segment once and keeps its count for later rows; new segments go to the library in batches
of about BATCH_BYTES bytes in UTF-8, whatever the lengths of the texts. The memory of counts is emptied beyond
MEMORY_SEGMENTS.

A text may be cut so only if the file's pre-tokenizer begins a piece at each such space and nothing else looks across it: no
normalizer, no special token with white space in or around it, and either the byte-level pre-tokenizer with its own pattern and no
added space or a split by that pattern before it. `cuts_at_spaces` reads that from the file; texts of other files are counted whole.

Defined cases: a null or empty text has no tokens; rows that repeat a doc_id get a row each; an empty table
gives no rows.
"""

from __future__ import annotations

import json
import re

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import keyed, unkeyed

BATCH_BYTES = 1 << 20
MEMORY_SEGMENTS = 400_000
SAFE = re.compile(r"(?<=\S)(?= \S)")


def _bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def cuts_at_spaces(tokenizer: dict) -> bool:
    """Whether texts may be cut before single spaces between two characters that aren't white space. tokenizer: what a .json file holds."""

    def byte_level(p: dict, pattern: bool) -> bool:
        return p.get("type") == "ByteLevel" and not p.get("add_prefix_space", True) and p.get("use_regex", True) == pattern

    def split(p: dict) -> bool:
        return p.get("type") == "Split" and p.get("pattern") == {"Regex": public_tokenizers.PATTERN} and p.get("behavior") == "Isolated" and not p.get("invert")

    own = tokenizer.get("pre_tokenizer") or {}
    parts = own.get("pretokenizers", []) if own.get("type") == "Sequence" else [own]
    pieces = len(parts) == 1 and byte_level(parts[0], True) or len(parts) == 2 and split(parts[0]) and byte_level(parts[1], False)
    whole = not tokenizer.get("normalizer") and not tokenizer.get("truncation")
    return bool(pieces) and whole and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in tokenizer.get("added_tokens", []))


def counter(path: str, cut: bool):
    """A function from an iterator of Arrow batches (id, text) to batches of (id, n_bytes, n_tokens)."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        known: dict[str, int] = {}

        def learn(new: list[str]) -> None:
            part, held = [], 0
            for s in new + [None]:
                if s is None or held >= BATCH_BYTES:
                    known.update(zip(part, (len(e) for e in tok.encode_batch_fast(part, add_special_tokens=False)), strict=True))
                    part, held = [], 0
                if s is not None:
                    part.append(s)
                    held += _bytes(s)

        for b in batches:
            ids, texts, size, count = b.column(0).to_pylist(), b.column(1).to_pylist(), [], []
            at = 0
            while at < len(texts):
                # rows up to the byte balance, or one long text
                cuts, held, end = [], 0, at
                while end < len(texts) and (end == at or held < 4 * BATCH_BYTES):
                    t = texts[end] or ""
                    size.append(_bytes(t))
                    held += size[-1]
                    cuts.append(SAFE.split(t) if cut else [t])
                    end += 1
                if len(known) > MEMORY_SEGMENTS:
                    known.clear()
                learn(list({s for c in cuts for s in c if s not in known}))
                count += [sum(map(known.__getitem__, c)) for c in cuts]
                at = end
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(count, pa.int64())], ["_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, cut: bool | None = None) -> DataFrame:
    """id, n_bytes, n_tokens (long) and over_limit for each row. path: a .json file that the driver and every executor have. cut: None takes what the file
    allows; True is refused where it doesn't."""
    with open(path, encoding="utf-8") as f:
        allowed = cuts_at_spaces(json.load(f))
    if cut and not allowed:
        raise ValueError(f"texts may not be cut at spaces for {path}")
    cut = allowed if cut is None else cut
    base = docs.select(keyed(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = base.mapInArrow(counter(path, cut), "_id long, n_bytes long, n_tokens long")
    return out.select(unkeyed("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
