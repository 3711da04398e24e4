"""Token counts by heap-and-linked-list byte-pair merging.

The count of a text is its number of initial symbols minus the merges that
happen; no identifier is looked up or emitted. A segment's symbols (characters)
form a doubly linked list; a heap holds the adjacent pairs whose concatenation
is a piece, ordered by the piece's rank (its place by falling score) and then from
the left. The lowest pair is popped again and again; a pair whose symbols have
changed since it was pushed is skipped. A character without a piece of its own never merges and counts with
its UTF-8 bytes (byte fallback).

Vocabulary, scores and the flags of a ``.model`` file are read with its library;
merging is done here. Texts are cut where no piece of the file reaches across: at
the start of a run of blanks, at ASCII characters without a piece (line ends), and
between neighbours that no piece holds; what holds is read off the pieces. A worker
keeps the counts of short segments (at most twice ``KNOWN``). The job is one map over the documents: no shuffle,
nothing gathered, and a lost task repeats its own rows only.

Defined results: null text counts as empty, empty text has no tokens; the
strings of control pieces (``<s>``) inside a text are ordinary text, as the
library's default has it; texts of any length are counted whole, a segment of any
length (a text without blanks) in one heap; repeated rows are counted alike; an
empty table gives an empty result; the input's columns stay under ``row``, so
none can clash.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetlens.llm.common import packed

KNOWN = 500_000  # segments whose counts a worker remembers, and as many older ones
LONGEST_KNOWN = 64  # characters of a remembered segment
_BLANK = "▁"  # how the vocabulary writes a blank
_ROWS = 256  # texts decoded at once


class Known(dict):
    """Text -> number of tokens; computes what it doesn't hold. Short texts used since
    the last ``KNOWN`` new ones are kept, and as many older ones."""

    def __init__(self, compute: Callable[[str], int]):
        super().__init__()
        self.compute, self.older = compute, {}

    def __missing__(self, text: str) -> int:
        n = self.older.get(text)
        if n is None:
            n = self.compute(text)
        if len(text) <= LONGEST_KNOWN:
            if len(self) >= KNOWN:
                self.older = dict(self)
                self.clear()
            self[text] = n
        return n


def initial_symbols(symbols: str, ranks: dict[str, int]) -> int:
    """One for a character, or its bytes if it has no piece."""
    alone = "".join([c for c in symbols if c not in ranks])
    return len(symbols) - len(alone) + len(alone.encode()) if alone else len(symbols)


def merges(symbols: str, ranks: dict[str, int]) -> int:
    """How many pairs merge, lowest rank first, then from the left."""
    # A symbol is named by where it starts; after[i] is where it ends, which is
    # the next symbol's start. A heap entry is (rank, start, end) of a pair as
    # one integer. Symbols only grow, so a pair is as it was pushed if it still
    # ends there; the start of a symbol that was merged away leads nowhere.
    rank, n = ranks.get, len(symbols)
    bits = (n + 2).bit_length()
    two, mask = 2 * bits, (1 << bits) - 1
    after, before = list(range(1, n + 2)), list(range(-1, n))
    after.append(0)
    heap = [r << two | i << bits | i + 2 for i in range(n - 1) if (r := rank(symbols[i:i + 2])) is not None]
    heapify(heap)
    done = 0
    while heap:
        key = heappop(heap)
        start, end = key >> bits & mask, key & mask
        middle = after[start]
        if after[middle] != end:
            continue
        after[start], after[middle] = end, n + 1
        before[end] = start
        if end < n and (r := rank(symbols[start:(stop := after[end])])) is not None:
            heappush(heap, r << two | start << bits | stop)
        if (prior := before[start]) >= 0 and (r := rank(symbols[prior:end])) is not None:
            heappush(heap, r << two | prior << bits | end)
        done += 1
    return done


class PieceCounter:
    """Token counts of whole texts under one BPE ``.model`` file."""

    def __init__(self, model: bytes):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        every = range(sp.get_piece_size())
        plain = [i for i in every if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        scores = sorted({-sp.get_score(i) for i in plain})
        order = {x: k for k, x in enumerate(scores)}
        self.ranks = {sp.id_to_piece(i): order[-sp.get_score(i)] for i in plain}
        # the neighbours that some piece holds: between others nothing ever merges
        self.neighbours = {p[i:i + 2] for p in self.ranks for i in range(len(p) - 1)}
        probe = " ﬁ   x\t "
        if any(sp.is_unused(i) for i in plain) or not any(sp.is_byte(i) for i in every):
            raise ValueError("the model has unused pieces, or no bytes for unknown characters")
        if any(x[1] == _BLANK != x[0] for x in self.neighbours) or sp.normalize(probe) != _BLANK + probe.replace(" ", _BLANK):
            raise ValueError("the model changes texts first, or has pieces with a blank after another character")
        # ASCII characters without a piece (such as line ends) merge with nothing: one byte, one token
        alone = {chr(c) for c in range(128)} - self.ranks.keys() - {" "}
        if any(alone & set(x) for x in self.neighbours):
            raise ValueError("the model merges characters that have no piece of their own")
        cut = "".join(map(re.escape, sorted(alone)))
        self.segments = re.compile(f" +[^ {cut}]*|[^ {cut}]+").findall
        self.of_segment, self.of_part = Known(self.segment), Known(self.part)

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        # one blank is put before every text; the sign for a blank reads as one
        text = " " + text.replace(_BLANK, " ")
        found = self.segments(text)
        return sum(map(self.of_segment.__getitem__, found)) + len(text) - len("".join(found))

    def segment(self, segment: str) -> int:
        """Cut between neighbours that no piece holds."""
        symbols = segment.replace(" ", _BLANK)
        ends = [i for i in range(1, len(symbols)) if symbols[i - 1:i + 1] not in self.neighbours]
        return sum(self.of_part[symbols[a:b]] for a, b in zip([0, *ends], [*ends, len(symbols)]))

    def part(self, symbols: str) -> int:
        return initial_symbols(symbols, self.ranks) - merges(symbols, self.ranks)


def model_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


_COUNTERS: dict[int, PieceCounter] = {}


def token_counts(docs: DataFrame, text: str = "text", model: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``keep``, by default all), ``n_bytes`` (UTF-8) and
    ``n_tokens`` per input row."""
    spark = docs.sparkSession
    with open(model or model_path(), "rb") as f:
        file = spark.sparkContext.broadcast(f.read())
    body = F.coalesce(F.col("row")[text], F.lit(""))
    kept = F.struct(*[F.col("row")[c].alias(c) for c in (keep or docs.columns)])
    src = packed(docs).select(kept.alias("row"), F.octet_length(body).cast("long").alias("n_bytes"), body.alias("body"))

    def run(batches):
        key = hash(file.value)
        counter = _COUNTERS.get(key)
        if counter is None:
            _COUNTERS.clear()
            counter = _COUNTERS[key] = PieceCounter(file.value)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                rows = batch.slice(at, _ROWS)
                counts = pa.array(map(counter, rows.column(2).to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), counts], names=["row", "n_bytes", "n_tokens"])

    schema = T.StructType([src.schema["row"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return src.mapInArrow(run, schema)


def document_token_counts(docs: DataFrame, key: str = "doc_id", limit: int = 4096, **options) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every document."""
    out = token_counts(docs, keep=[key], **options)
    return out.select(F.col("row")[key].alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
