"""Byte-level BPE by a trie of words with last-token states.

The BPE encoding of a string is known from its last token: the rest is the
encoding of the shorter prefix before it. So one state per prefix is enough,
and prefixes are shared between words. Per chunk of texts, the distinct words
that aren't known yet go into a trie; a depth-first walk finds, for every node,
the token that ends the encoding of the node's prefix: the one token that is a
suffix of the prefix and that merging leaves apart from the last token of the
prefix before it. A word's ids are then read off its path from the end.

Texts are dealt out by Spark's partitions and encoded in chunks of bounded
size; memos are bounded and start anew when full, which changes no result. The
tokenizer file is read once on the driver (a vocabulary, bounded) and broadcast.

Defined results: null text is encoded as the empty text (no ids); texts of any
length are encoded whole; strings of added tokens inside a text get that
token's id, as in the library; repeated rows are encoded alike; an empty table
gives an empty result; the input's other columns are carried under ``row``. Of
``encoded_documents``, an input column named ``token_ids`` or ``n_tokens`` gives way to
the new one.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetlens.llm.common import bound_batches, packed

# The public pattern of byte-level BPE vocabularies (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Blocks whose letters, digits and white space haven't changed between Unicode
# versions; texts with other characters are split by the library itself.
SETTLED = r"[\u0000-ɏЀ-ҁḀ-ỿ‐-⁞₠-₫ぁ-ゖ一-龥가-힣]*"

CHUNK_WORDS = 100_000
KNOWN_WORDS = 300_000
KNOWN_PAIRS = 250_000


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


def _plain_split() -> re.Pattern:
    """SPLIT for settled characters with its classes spelled out, which the
    standard library's engine runs twice as fast."""
    def ranges(kind: str) -> str:
        member = regex.compile(kind)
        found = [c for c in range(0xD7A4) if settled.fullmatch(chr(c)) and member.fullmatch(chr(c))]
        steps = [k for k, c in enumerate(found) if k == 0 or found[k - 1] != c - 1]
        return "".join(f"\\u{found[a]:04x}-\\u{found[b - 1]:04x}" for a, b in zip(steps, [*steps[1:], len(found)]))

    settled = regex.compile(SETTLED.removesuffix("*"))
    letters, numbers, spaces = ranges(r"\p{L}"), ranges(r"\p{N}"), ranges(r"\s")
    out = (SPLIT.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]")
           .replace(r"\p{N}", f"[{numbers}]").replace(r"\S", f"[^{spaces}]").replace(r"\s", f"[{spaces}]"))
    return re.compile(out)


class TrieEncoder:
    """Encodes words with the vocabulary and merges of a tokenizer file."""

    def __init__(self, file: bytes) -> None:
        spec = json.loads(file)
        letter_byte = {c: b for b, c in enumerate(byte_letters())}
        to_bytes = lambda s: bytes(letter_byte[c] for c in s)
        self.ids = {to_bytes(s): i for s, i in spec["model"]["vocab"].items()}
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.size_of = {i: len(b) for i, b in self.bytes_of.items()}
        self.rank: dict[int, int] = {}  # of a pair of tokens, as one number
        self.made: dict[int, tuple[int, int, int]] = {i: (-1, i, i) for b, i in self.ids.items() if len(b) == 1}
        parts_of = [[self.ids[to_bytes(x)] for x in (m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        result = [self.ids[self.bytes_of[a] + self.bytes_of[b]] for a, b in parts_of]
        first_made = {c: n for n, c in reversed(list(enumerate(result)))}
        for n, (a, b) in enumerate(parts_of):
            if max(first_made.get(a, -1), first_made.get(b, -1)) >= n:
                raise ValueError("a merge must come after those that make its parts")
            self.rank[a << 20 | b] = n
        # A token's rank and parts, if its bytes alone merge into it; only such
        # tokens can end an encoding.
        for n, (a, b) in enumerate(parts_of):
            if a in self.made and b in self.made and self.no_merge_across(a, b, n):
                self.made.setdefault(result[n], (n, a, b))
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.added.items():
            self.bytes_of[i] = text.encode()
        self.ids = {b: i for b, i in self.ids.items() if i in self.made}
        # The state of a prefix is its longest end that starts a token; from it
        # come the tokens that are ends of the prefix, longest first. Both memos
        # are bounded by the vocabulary.
        self.starts = [b""]
        self.start_of = {b"": 0}
        for b in self.ids:
            for k in range(1, len(b) + 1):
                if b[:k] not in self.start_of:
                    self.start_of[b[:k]] = len(self.starts)
                    self.starts.append(b[:k])
        self.next_state: dict[int, int] = {}
        self.ends_of: dict[int, tuple[tuple[int, int], ...]] = {}
        self.apart: dict[int, bool] = {}
        self.four = {i: i.to_bytes(4, "little") for i in self.bytes_of}
        self.added_ids = {i: self.four[i] for i in self.added.values()}
        self.known: dict[str | int, bytes] = dict(self.added_ids)
        self.split = _plain_split()
        self.settled = regex.compile(SETTLED)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.library = None

    def no_merge_across(self, u: int, t: int, before: int) -> bool:
        """Whether no merge of a rank below ``before`` joins the bytes of ``u`` to
        those of ``t`` that follow.

        Merges run by rank, equal ones from left to right, so the tokens at the
        border follow from each one's parts: go back in time, undo the later of
        the two, and see whether the pair before merged while it was there.
        """
        made, rank = self.made, self.rank
        left_until = right_until = before
        while True:
            r = rank.get(u << 20 | t)
            if r is not None and r < left_until and r <= right_until and r < before:
                return False
            (n, _, left), (m, right, _) = made[u], made[t]
            if n < 0 and m < 0:
                return True
            if n > m:
                u, left_until = left, n
            else:
                t, right_until = right, m

    def stay_apart(self, u: int, t: int) -> bool:
        """Whether merging the bytes of both tokens gives just them again."""
        key = u << 20 | t
        found = self.apart.get(key)
        if found is None:
            if len(self.apart) >= KNOWN_PAIRS:
                self.apart.clear()
            found = self.apart[key] = self.no_merge_across(u, t, len(self.rank))
        return found

    def learn(self, new: Iterable[str]) -> dict[str, bytes]:
        """Encode distinct words, given in order.

        Their trie is held as the ordered words: a node is a prefix, its words
        are next to each other. Going from word to word walks the trie depth
        first: back up to the shared prefix, whose states stay, and down along
        the bytes of the word that no earlier word had.
        """
        done: dict[str, bytes] = {}
        last, state = [-1], [0]  # of the first d bytes of the node's prefix: last token, state
        path = b""
        size, apart, next_state, ends_of, four = self.size_of, self.apart, self.next_state, self.ends_of, self.four
        for word in new:
            byte = word.encode()
            depth = 0
            for x, y in zip(path, byte):
                if x != y:
                    break
                depth += 1
            path = byte
            del last[depth + 1:], state[depth + 1:]
            now = state[depth]
            for c in byte[depth:]:
                depth += 1
                to = next_state.get(now << 8 | c)
                now = self.enter(now, c) if to is None else to
                for t, n in ends_of[now]:
                    if n == depth:
                        break
                    same = apart.get(last[depth - n] << 20 | t)
                    if same or same is None and self.stay_apart(last[depth - n], t):
                        break
                last.append(t)
                state.append(now)
            ids = []
            while depth:
                t = last[depth]
                ids.append(four[t])
                depth -= size[t]
            ids.reverse()
            done[word] = b"".join(ids)
        return done

    def enter(self, state: int, byte: int) -> int:
        """The state after one more byte, with the tokens that end there."""
        tail = self.starts[state] + bytes((byte,))
        while tail not in self.start_of:
            tail = tail[1:]
        now = self.next_state[state << 8 | byte] = self.start_of[tail]
        if now not in self.ends_of:
            ends = (tail[k:] for k in range(len(tail)))
            self.ends_of[now] = tuple((self.ids[e], len(e)) for e in ends if e in self.ids)
        return now

    def words(self, text: str) -> Iterator[str | int]:
        """Words of a text in order; added tokens as their ids."""
        parts = self.specials.split(text) if self.specials else [text]
        for part in parts:
            if part in self.added:
                yield self.added[part]
            elif self.settled.fullmatch(part):
                yield from (m[0] for m in self.split.finditer(part)) if len(part) > 1_000_000 else self.split.findall(part)
            else:
                if self.library is None:
                    from tokenizers import pre_tokenizers
                    self.library = pre_tokenizers.ByteLevel(add_prefix_space=False)
                yield from (part[a:b] for _, (a, b) in self.library.pre_tokenize_str(part))

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, in order."""
        waiting: list[tuple[list, bool]] = []  # words, whether their text ends here
        held, parts = 0, []
        for text in texts:
            words = self.words(text)
            while True:
                some = list(itertools.islice(words, CHUNK_WORDS))
                ends = len(some) < CHUNK_WORDS
                waiting.append((some, ends))
                held += len(some) + 1
                if held >= CHUNK_WORDS:
                    yield from self.flush(waiting, parts)
                    waiting, held = [], 0
                if ends:
                    break
        yield from self.flush(waiting, parts)

    def flush(self, waiting: list[tuple[list, bool]], parts: list[bytes]) -> Iterator[bytes]:
        distinct = set(itertools.chain.from_iterable(some for some, _ in waiting))
        known = self.known
        new = [w for w in distinct if w not in known]
        if len(known) + len(new) > KNOWN_WORDS:
            # only the words of this chunk stay
            self.known = known = self.added_ids | {w: known[w] for w in distinct if w in known}
        new.sort()
        known.update(self.learn(new))
        for some, ends in waiting:
            parts.append(b"".join([known[w] for w in some]))
            if ends:
                yield b"".join(parts)
                parts.clear()

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


_ENCODERS: dict[int, TrieEncoder] = {}


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def encode_texts(docs: DataFrame, text: str = "text", tokenizer: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``keep``, by default all), ``ids`` (little-endian
    unsigned 32-bit integers) and ``decoded`` (their decoding) per input row."""
    spark = docs.sparkSession
    bound_batches(spark)
    with open(tokenizer or tokenizer_path(), "rb") as f:
        file = spark.sparkContext.broadcast(f.read())
    kept = docs.select(*[docs[f"`{c}`"] for c in (keep or docs.columns)])
    src = packed(docs).select(F.struct(*[F.col("row")[c].alias(c) for c in kept.columns]).alias("row"),
                              F.coalesce(F.col("row")[text], F.lit("")).alias("body"))
    # a text that is carried anyway goes to the workers once
    carried = kept.columns.index(text) if text in kept.columns and kept.schema[text].dataType == T.StringType() else None
    if carried is not None:
        src = src.select("row")

    def run(batches):
        key = hash(file.value)
        encoder = _ENCODERS.get(key)
        if encoder is None:
            _ENCODERS.clear()
            encoder = _ENCODERS[key] = TrieEncoder(file.value)
        for batch in batches:
            # small slices: a slice's ids and decoded texts are held at once
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                texts = rows.column(1) if carried is None else rows.column(0).field(carried)
                ids = list(encoder.encode(t or "" for t in texts.to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(ids, pa.binary()), pa.array([encoder.decode(x) for x in ids], pa.string())],
                    names=["row", "ids", "decoded"])

    schema = T.StructType([src.schema["row"], T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    return src.mapInArrow(run, schema)


def encoded_documents(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents with their ids and number of tokens beside their columns."""
    out = encode_texts(docs, text, **options)
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("token_ids", "n_tokens")]
    return out.select(*own, F.col("ids").alias("token_ids"), (F.length("ids") / 4).cast("long").alias("n_tokens"))
