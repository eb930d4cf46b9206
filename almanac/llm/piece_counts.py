"""Token counts by rank-synchronous array merging.

Texts are cut into pre-tokens that no vocabulary piece can span. New pre-tokens of a batch, of any length, lie in one ragged
array of symbol ids; each turn finds the lowest-rank pair of every sequence, applies it in all sequences at once, and closes
the gaps; what survives is counted. Counts are remembered by pre-token up to a bound."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from almanac.llm.common import fresh, widen

SPACE = "▁"  # stands for a space inside pieces
REMEMBERED = 400_000
NEVER = np.iinfo(np.int64).max
NONE = NEVER - 1


@dataclass
class Vocabulary:
    """``cost`` of a single character: 1 if it is a piece, else its UTF-8 bytes (byte fallback). ``pair``: sorted keys
    a * size + b of the pairs that make a piece, with the piece's id and rank. ``span``: sorted keys of all pairs that some piece
    may span, with their rank, or ``NONE`` if they make no piece themselves. ``alone``: pieces that are in a pair of a rank
    not above their own, so that a merge of them may be followed by a merge that comes before the others. ``longest``: the
    longest run of spaces that is a piece; ``runs``: the tokens of a run of spaces, by its length; each ``longest`` more make
    one more."""

    chars: dict[str, int]
    size: int
    pair: np.ndarray
    made: np.ndarray
    rank: np.ndarray
    span: np.ndarray
    span_rank: np.ndarray
    alone: np.ndarray
    longest: int
    runs: list[int] = field(default_factory=list)
    known: dict[str, int] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}


def _ids(ids: dict[str, int], piece: str, start: range | int, stop: range | int) -> list[int]:
    """Ids of the pieces that are parts of ``piece`` between the places of ``start`` and ``stop``, one of which is fixed."""
    parts = (piece[a:stop] for a in start) if isinstance(start, range) else (piece[start:b] for b in stop)
    return [ids[x] for x in parts if x in ids]


def load(path: str) -> Vocabulary:
    """From a sentencepiece BPE model with byte fallback, no normalization and a dummy prefix; other kinds are refused."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, spec = model.normalizer_spec, model.trainer_spec
    if norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not spec.byte_fallback or spec.model_type != 2:
        raise ValueError("only BPE models with byte fallback, a dummy prefix and no normalization")
    pieces = {p.piece: p.score for p in model.pieces if p.type == 1}
    if any(SPACE in p.lstrip(SPACE) or (p[:2] == SPACE * 2 and p.strip(SPACE)) for p in pieces):
        raise ValueError("a piece has a space after its start")
    order = {score: i for i, score in enumerate(sorted(set(pieces.values()), reverse=True))}
    ids = {p: i for i, p in enumerate(pieces)}
    size = len(ids)
    if any(c not in ids for p in pieces for c in p):
        raise ValueError("a piece has a character that is no piece")
    rows = [(ids[p[:i]] * size + ids[p[i:]], ids[p], order[s]) for p, s in pieces.items() for i in range(1, len(p)) if p[:i] in ids and p[i:] in ids]
    pair, made, rank = (np.array(x, np.int64) for x in zip(*sorted(rows), strict=True))
    own = np.full(size, -1, np.int64)
    own[made] = rank
    alone = np.zeros(size, bool)
    for part in (pair // size, pair % size):
        alone[part[own[part] >= rank]] = True
    span = np.array(sorted({a * size + b for p in pieces for i in range(1, len(p)) for a in _ids(ids, p, range(i), i) for b in _ids(ids, p, i, range(i + 1, len(p) + 1))}), np.int64)
    span_rank = np.full(len(span), NONE)
    span_rank[np.searchsorted(span, pair)] = rank
    longest = max(len(p) for p in pieces if not p.strip(SPACE))
    last = {s for p, s in pieces.items() if len(p) > 1 and not p.strip(SPACE)}
    v = Vocabulary({c: i for c, i in ids.items() if len(c) == 1}, size, pair, made, rank, span, span_rank, alone, longest)
    v.runs = [0, *merged_counts(v, [SPACE * k for k in range(1, 3 * longest)])[0].tolist()]
    if last != {min(pieces.values())} or any(v.runs[k + longest] != v.runs[k] + 1 for k in range(2 * longest)):
        raise ValueError("runs of spaces aren't merged last and in equal parts")
    return v


def merged_counts(v: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each word and whether its first symbol is a bare space at the end. Characters without a piece are symbols
    that never merge and cost their bytes.

    Symbols of all words lie in one array, cut into sequences wherever no piece can span two neighbours. Such a cut is for
    good, so sequences get short whatever the length of their word, and each turn merges the lowest-rank pairs of all of
    them. In one turn a sequence gives all pairs of its lowest rank, from the left, up to the first whose product makes a
    pair of no higher rank, which must come first."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    text = "".join(words)
    symbol = np.array([v.chars.get(c, -1) for c in text], np.int64)
    unknown = symbol < 0
    cost = np.ones(len(symbol), np.int64)
    cost[unknown] = [len(text[i].encode("utf-8", "surrogatepass")) for i in np.flatnonzero(unknown).tolist()]
    word = np.repeat(np.arange(len(words)), n)
    total = np.bincount(word, cost - 1, len(words)).astype(np.int64)
    bare, space = np.zeros(len(words), bool), v.chars[SPACE]
    begins = np.r_[True, word[1:] != word[:-1]] if len(word) else np.zeros(0, bool)
    seq = word.copy()

    def rank_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of pairs; ``NONE`` if they make no piece but a piece may span them, ``NEVER`` if none may."""
        key = np.where((a >= 0) & (b >= 0), a * v.size + b, -1)
        at = np.minimum(np.searchsorted(v.span, key), len(v.span) - 1)
        return np.where(v.span[at] == key, v.span_rank[at], NEVER)

    while len(symbol):
        rank = np.full(len(symbol), NEVER)
        rank[:-1] = np.where(seq[:-1] == seq[1:], rank_of(symbol[:-1], symbol[1:]), NEVER)
        heads = np.flatnonzero(np.r_[True, rank[:-1] == NEVER])
        seq = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(symbol)]))
        best = np.minimum.reduceat(rank, heads)
        live = (best < NONE)[seq]
        if not live.all():  # what can't merge any more is counted and leaves
            done = ~live
            total += np.bincount(word[done], minlength=len(words))
            bare[word[done & begins & (symbol == space)]] = True
            seq, symbol, word, rank, begins = seq[live], symbol[live], word[live], rank[live], begins[live]
            if not len(symbol):
                break
        lowest = best[seq]
        spot = np.flatnonzero(rank == lowest)
        # of pairs that overlap in a row, every other one, from the left
        broken = np.r_[True, spot[1:] != spot[:-1] + 1]
        origin = np.maximum.accumulate(np.where(broken, np.arange(len(spot)), 0))
        spot = spot[(np.arange(len(spot)) - origin) % 2 == 0]
        made = v.made[np.searchsorted(v.pair, symbol[spot] * v.size + symbol[spot + 1])]
        odd = np.flatnonzero(v.alone[made])
        if len(odd):
            at = spot[odd]
            left = np.where((odd > 0) & (spot[odd - 1] == at - 2), made[odd - 1], symbol[at - 1])
            new_left = np.where((at > 0) & (seq[at - 1] == seq[at]), rank_of(left, made[odd]), NEVER)
            right = np.minimum(at + 2, len(symbol) - 1)
            new_right = np.where((at + 2 == right) & (seq[right] == seq[at]), rank_of(made[odd], symbol[right]), NEVER)
            stop = odd[np.minimum(new_left, new_right) <= rank[at]]
            if len(stop):
                owner = seq[spot]
                first = np.full(int(owner[-1]) + 1, len(spot))
                np.minimum.at(first, owner[stop], stop)
                keep = np.arange(len(spot)) <= first[owner]
                spot, made = spot[keep], made[keep]
        symbol[spot] = made
        stay = np.ones(len(symbol), bool)
        stay[spot + 1] = False
        seq, symbol, word, begins = seq[stay], symbol[stay], word[stay], begins[stay]
    return total, bare


#: A pre-token: spaces with what follows up to a space or line feed, or line feeds (which no piece of these models holds).
PRE = re.compile(f"\n+|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


def _count(v: Vocabulary, new: list[str]) -> list[int]:
    words, spaces = [], []
    for t in new:
        word = t.lstrip(SPACE)
        k = len(t) - len(word)
        spaces.append(k)
        words.append(SPACE + word if k and word else word)
    filled = [i for i, w in enumerate(words) if w]
    total, bare = np.zeros(len(new), np.int64), np.zeros(len(new), bool)
    if filled:
        total[filled], bare[filled] = merged_counts(v, [words[i] for i in filled])
    out = []
    for n, left, word, k in zip(total.tolist(), bare.tolist(), words, spaces, strict=True):
        # the word's own space is in n; if it stayed bare, it belongs to the run, else the run is one shorter
        run = k if not word else (k if left else k - 1) if k else 0
        out.append(n - (1 if word and k and left else 0) + run // v.longest + v.runs[run % v.longest])
    return out


def counts(v: Vocabulary, texts: list[str]) -> list[int]:
    """Tokens of each text; an empty text has none, any other begins with a dummy space."""
    split = [PRE.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
    out = []
    if len(v.known) > REMEMBERED:
        v.known.clear()
    new = list({p for pieces in split for p in pieces if p not in v.known})
    long = {}
    for a in range(0, len(new), 200_000):
        part = new[a : a + 200_000]
        for p, n in zip(part, _count(v, part), strict=True):
            (v.known if len(p) <= 64 else long)[p] = n
    known = v.known
    for pieces in split:
        out.append(sum([n if (n := known.get(p)) is not None else long[p] for p in pieces]))
    return out


COUNTS = "struct<n_bytes: long, n_tokens: long, over_limit: boolean>"


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, limit: int = 4096) -> tuple[DataFrame, str]:
    """``docs`` (text and any others) with a struct column, whose name is returned too: UTF-8 bytes, tokens, and whether these
    are over ``limit``. Null texts are empty and have no tokens."""
    shared, name = docs.sparkSession.sparkContext.broadcast(vocabulary), fresh(docs.columns, "count")

    def factory():
        own = shared.value

        def run(texts: list[str]) -> pa.Array:
            tokens = np.array(counts(own, texts), np.int64)
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            return pa.StructArray.from_arrays([pa.array(size, pa.int64()), pa.array(tokens), pa.array(tokens > limit)], ["n_bytes", "n_tokens", "over_limit"])

        return run

    return widen(docs, name, COUNTS, factory), name
