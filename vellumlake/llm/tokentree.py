"""Edit-aware token counts: a segment tree of pre-tokens for each document, re-encoded only where edits touch it.

A text is split into pre-tokens by the tokenizer's pattern; a pre-token's token count doesn't depend on its surroundings.  Pre-tokens lie in
blocks of about BLOCK; a binary tree over the blocks holds the sums of characters and tokens.  A batch of edits goes over the text once, from
left to right: each edit finds its place by descending the tree, splits again from a few characters before it (as far as the pattern can
look ahead) until a boundary falls on an old one behind it, and encodes only these pre-tokens.  Blocks that no edit touches are taken over
with their sums; blocks that grew long are split; then the sums above the touched blocks are updated.  Blocks and sums are kept with the text.

The vocabulary is a rank file of a public tokenizer; its folder is a parameter and it is read where the tasks run.

Defined cases: a null text has null counts; an empty one 0 tokens; edits are (start, end, replacement) in characters of the text before
any of them, applied together, cut to the text, a null replacement counting as empty; an edit whose start or end is null is ignored; edits
are ordered by start, the longest first, then by seq (where they have one; nulls first) and by replacement, whatever order their rows come in: of overlapping edits
the first in that order holds, and insertions at one place all hold, in that order; edits of unknown documents are ignored; repeated
rows are counted each; extra columns are ignored; an empty table gives an empty result.  A document's edits are applied in one task, as its text is.
"""

from __future__ import annotations

import base64
import math
import os
from itertools import accumulate, chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pii import mentions
from .scratch import tokenizer_dir

VOCABULARY = "byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 128
LOOK = 3  # the pattern looks at most so many characters beyond a pre-token's last one
KEPT = 1_000_000  # pre-tokens whose counts a task remembers; forgotten ones are encoded again


class Counter:
    """Token counts of pre-tokens by a byte-pair vocabulary."""

    def __init__(self, folder: str, vocabulary: str = VOCABULARY) -> None:
        import tiktoken

        with open(os.path.join(folder, vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        out = [known.get(p) for p in pieces]
        if None in out:
            if len(known) > KEPT:
                known.clear()
            encode = self.encoding.encode_ordinary
            for i, n in enumerate(out):
                if n is None:
                    p = pieces[i]
                    n = known.get(p)
                    if n is None:
                        n = len(encode(p))
                        if len(p) <= 64:
                            known[p] = n
                    out[i] = n
        return out


class TokenTree:
    """The pre-tokens of one text in blocks, and heaps of character and token sums over the blocks."""

    def __init__(self, counter: Counter, text: str, lengths=None, counts=None, blocks=None, chars=None, tokens=None) -> None:
        self.counter, self.text, self.encoded = counter, text, 0
        if lengths is None:
            pieces = counter.split.findall(text)
            lengths, counts = list(map(len, pieces)), counter.counts(pieces)
        if blocks is None:
            blocks = [min(BLOCK, len(lengths) - i) for i in range(0, len(lengths), BLOCK)] or [0]
        ends = list(accumulate(blocks))
        self.lengths = [lengths[e - n : e] for e, n in zip(ends, blocks)]
        self.counts = [counts[e - n : e] for e, n in zip(ends, blocks)]
        if chars is None:
            self._build(list(map(sum, self.lengths)), list(map(sum, self.counts)))
        else:
            self.width, self.chars, self.tokens = len(chars) // 2, chars, tokens

    def _build(self, chars: list[int], tokens: list[int]) -> None:
        """The heaps over the given sums of blocks."""
        self.width = 1 << max(0, (len(chars) - 1).bit_length())
        heaps = []
        for leaves in (chars, tokens):
            heap = [0] * (2 * self.width)
            heap[self.width : self.width + len(leaves)] = leaves
            for i in range(self.width - 1, 0, -1):
                heap[i] = heap[2 * i] + heap[2 * i + 1]
            heaps.append(heap)
        self.chars, self.tokens = heaps

    @property
    def total(self) -> int:
        return self.tokens[1]

    def place(self, at: int) -> tuple[int, int, int]:
        """(block, piece in it, the piece's start) of the pre-token that holds character `at`."""
        i, before = 1, 0
        while i < self.width:
            i *= 2
            if before + self.chars[i] <= at:
                before += self.chars[i]
                i += 1
        block = min(i - self.width, len(self.lengths) - 1)
        if i - self.width > block:
            before = self.chars[1] - self.chars[self.width + block]
        for k, n in enumerate(self.lengths[block]):
            if before + n > at:
                return block, k, before
            before += n
        return block, len(self.lengths[block]), before

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters start:end by `new`."""
        self._replace([(start, end, new)])

    def _replace(self, edits: list[tuple[int, int, str]]) -> None:
        """All of the edits, which are in order and don't overlap."""
        parts, last = [], 0
        for s, e, new in edits:
            parts += [self.text[last:s], new]
            last = e
        text = "".join(parts) + self.text[last:]
        size, out = len(text), _Blocks()
        b, k, pos, shift, i = 0, 0, 0, 0, 0  # as far as old pre-tokens are taken over; shift: from old to new places
        while i < len(edits):
            nb, nk, begin = self.place(max(0, edits[i][0] - LOOK))
            if nk:
                nk, begin = nk - 1, begin - self.lengths[nb][nk - 1]
            elif begin:
                nb, nk, begin = self.place(begin - 1)
            if begin < pos:
                nb, nk, begin = b, k, pos
            out.copy(self, b, k, nb, nk)
            b, k, pos = nb, nk, begin
            end = stop = 0
            pieces, reached, found = [], False, False
            for m in self.counter.split.finditer(text, begin + shift):
                pieces.append(m.group())
                at = m.end()
                while i < len(edits) and edits[i][0] + shift < at + LOOK:  # this pre-token may hang on the edit
                    s, end, new = edits[i]
                    stop = s + shift + len(new)
                    shift += len(new) - (end - s)
                    i, reached = i + 1, True
                if not reached or at < stop:
                    continue
                while b < len(self.lengths) and pos + shift < at:
                    if k < len(self.lengths[b]):
                        pos += self.lengths[b][k]
                        k += 1
                    else:
                        b, k = b + 1, 0
                if pos + shift == at and pos >= end:
                    found = True
                    break
            if not found:  # as far as the text goes
                b, k, pos, i = len(self.lengths) - 1, len(self.lengths[-1]), len(self.text), len(edits)
            elif b == len(self.lengths):
                b, k = b - 1, len(self.lengths[-1])
            self.encoded += len(pieces)
            out.add(list(map(len, pieces)), self.counter.counts(pieces))
        out.copy(self, b, k, len(self.lengths) - 1, len(self.lengths[-1]))
        out.flush()
        was, self.text = self.lengths, text
        self.lengths, self.counts = out.lengths or [[]], out.counts or [[]]
        changed = [j for j, x in enumerate(self.lengths) if j >= len(was) or x is not was[j]]
        if len(was) == len(self.lengths) and len(changed) * self.width.bit_length() < len(was):
            for j in changed:
                self._sum(j)
        else:
            self._build(out.chars or [0], out.tokens or [0])

    def _sum(self, block: int) -> None:
        i = self.width + block
        self.chars[i], self.tokens[i] = sum(self.lengths[block]), sum(self.counts[block])
        while i > 1:
            i //= 2
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def apply(self, edits) -> int:
        """All edits (start, end, replacement, and perhaps seq), given in places of the text as it is now; how many held."""
        size, good, last = len(self.text), [], 0
        known = ((s, -e, seq[0] if seq and seq[0] is not None else -math.inf, n or "") for s, e, n, *seq in edits if s is not None and e is not None)
        for s, e, _, new in sorted(known):
            s, e = max(0, min(s, size)), max(0, min(-e, size))
            if e >= s >= last:
                good.append((s, e, new))
                last = e
        if good:
            self._replace(good)
        return len(good)

    def state(self) -> dict:
        """What is kept of a tree."""
        return {"text": self.text, "lengths": list(chain(*self.lengths)), "counts": list(chain(*self.counts)), "blocks": list(map(len, self.lengths)), "char_sums": self.chars, "token_sums": self.tokens, "tokens": self.total}


class _Blocks:
    """Blocks in the making: whole old ones are taken over, pieces between them gathered."""

    def __init__(self) -> None:
        self.lengths, self.counts, self.chars, self.tokens = [], [], [], []
        self.some: tuple[list, list] = ([], [])

    def add(self, lengths: list[int], counts: list[int]) -> None:
        self.some[0].extend(lengths)
        self.some[1].extend(counts)

    def flush(self) -> None:
        n, m = self.some
        parts = max(1, len(n) // BLOCK)
        cuts = [len(n) * i // parts for i in range(parts + 1)]
        for i, j in zip(cuts, cuts[1:]):
            if j > i:
                self._put(n[i:j], m[i:j], sum(n[i:j]), sum(m[i:j]))
        self.some = ([], [])

    def _put(self, lengths, counts, chars, tokens) -> None:
        for to, x in ((self.lengths, lengths), (self.counts, counts), (self.chars, chars), (self.tokens, tokens)):
            to.append(x)

    def copy(self, tree: TokenTree, b0: int, k0: int, b1: int, k1: int) -> None:
        """Old pre-tokens from a place up to another."""
        for b in range(b0, b1 + 1):
            lo, hi = k0 if b == b0 else 0, k1 if b == b1 else len(tree.lengths[b])
            if lo == 0 < hi == len(tree.lengths[b]) and (not self.some[0] or len(self.some[0]) >= BLOCK // 4):
                if self.some[0]:
                    self.flush()
                self._put(tree.lengths[b], tree.counts[b], tree.chars[tree.width + b], tree.tokens[tree.width + b])
            elif lo < hi:
                self.add(tree.lengths[b][lo:hi], tree.counts[b][lo:hi])


TREES = "doc_id long, text string, lengths array<int>, counts array<int>, blocks array<int>, char_sums array<long>, token_sums array<long>, tokens long"
_I, _L = pa.list_(pa.int32()), pa.list_(pa.int64())
_ARROW = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lengths", _I), ("counts", _I), ("blocks", _I), ("char_sums", _L), ("token_sums", _L), ("tokens", pa.int64())])


def token_trees(docs: DataFrame, tokenizers: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """The state that is kept of each document: its text, the lengths and counts of its pre-tokens, their blocks, the sums over these, and its tokens."""
    folder = tokenizers or tokenizer_dir()

    def run(batches):
        counter = Counter(folder, vocabulary)
        for batch in batches:
            rows = [{"doc_id": i} | ({} if text is None else TokenTree(counter, text).state()) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, TREES)


def apply_edits(trees: DataFrame, edits: DataFrame, tokenizers: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """Trees after edits (doc_id, start, end, replacement, and perhaps seq): the same columns; documents without an edit pass as they are."""
    folder = tokenizers or tokenizer_dir()
    seq = F.col("seq").cast("long") if "seq" in edits.columns else F.lit(None).cast("long")
    one = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("replacement").cast("string").alias("replacement"), seq.alias("seq"))
    lists = edits.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.collect_list(one).alias("edits"))

    def run(batches):
        counter = Counter(folder, vocabulary)
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                edits = r.pop("edits")
                if edits and r["text"] is not None:
                    tree = TokenTree(counter, r["text"], r["lengths"], r["counts"], r["blocks"], r["char_sums"], r["token_sums"])
                    tree.apply((x["start"], x["end"], x["replacement"], x["seq"]) for x in edits)
                    r |= tree.state()
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    names = [f.name for f in _ARROW]
    joined = trees.select(*names).join(lists, F.col("doc_id") == F.col("__id"), "left").select(*names, "edits")
    return joined.mapInArrow(run, TREES)


def redactions(text: str | None):
    """Edits that take strictly valid identifiers out of a text."""
    return [(a, b, f"[{kind.upper()}]") for a, b, _, _, kind in mentions(text or "") if kind]


def edit_counts(docs: DataFrame, edits=redactions, tokenizers: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, pretokens, tokens_before, edits, reencoded (pre-tokens encoded again), tokens_after of each row of docs.

    `edits` gives a text's edits.  Trees are built, edited and dropped in one pass; token_trees and apply_edits keep them.
    """
    folder = tokenizers or tokenizer_dir()

    def run(batches):
        counter = Counter(folder, vocabulary)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                if text is None:
                    rows.append((None,) * 5)
                    continue
                tree = TokenTree(counter, text)
                before, size = tree.total, sum(map(len, tree.lengths))
                rows.append((size, before, tree.apply(edits(text)), tree.encoded, tree.total))
            cols = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "pretokens", "tokens_before", "edits", "reencoded", "tokens_after"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, pretokens long, tokens_before long, edits long, reencoded long, tokens_after long")
