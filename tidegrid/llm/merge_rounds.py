"""Byte-pair merges of many words at once, in numpy: the core that the tokenizers here share."""

from __future__ import annotations

import heapq
from functools import cached_property

import numpy as np

NO_RANK = np.iinfo(np.int32).max

#: Slots of the pair table, and symbols from which a word is merged one step at a time: rounds grow with its length.
TABLE = 1 << 20
LONG = 4000


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


def _hash_table(keys: list[int], values: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """Open addressing with linear probing: keys (-1: free), values, longest probe."""
    if len(keys) > TABLE // 2:
        raise ValueError("too many pairs for the table")
    at, value, probes = np.full(TABLE, -1, dtype=np.int64), np.full(TABLE, -1, dtype=np.int32), 1
    for key, v, slot in zip(keys, values, _slot(np.array(keys, dtype=np.int64)).tolist(), strict=True):
        step = 0
        while at[(slot + step) % TABLE] >= 0:
            step += 1
        at[(slot + step) % TABLE], value[(slot + step) % TABLE] = key, v
        probes = max(probes, step + 1)
    return at, value, probes + 1


class MergeTable:
    """Merges by their pair of symbols.

    ``merges`` holds (left, right, rank, piece); lower ranks merge first, equal
    ranks from the left. ``size`` is above every symbol.
    """

    def __init__(self, size: int, merges: list[tuple[int, int, int, int]]):
        self.size = size
        self.left, self.right = (np.array([m[k] for m in merges], dtype=np.int32) for k in (0, 1))
        self.rank = np.array([m[2] for m in merges], dtype=np.int32)
        self.piece = np.array([m[3] for m in merges], dtype=np.int64)
        self.pair_key, self.pair_merge, self.probes = _hash_table([m[0] * size + m[1] for m in merges], list(range(len(merges))))

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of the merge of each pair, -1 where there is none (or a side is unknown)."""
        key = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.size + right, -2)
        at = _slot(key)
        found = self.pair_key[at]
        made = np.where(found == key, self.pair_merge[at], -1)
        open_at = np.flatnonzero((found != key) & (found >= 0))
        for step in range(1, self.probes):
            if not len(open_at):
                break
            slot = (at[open_at] + step) & (TABLE - 1)
            found = self.pair_key[slot]
            made[open_at] = np.where(found == key[open_at], self.pair_merge[slot], -1)
            open_at = open_at[(found != key[open_at]) & (found >= 0)]
        return made

    def merge(self, sym: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat symbols of all words after merging, and each word's symbol count.

        Negative symbols are unknown and never merge. Each round finds every word's least pair rank, merges all of its
        occurrences from the left at once, and compacts the arrays; words whose
        pairs are all unknown leave. Where a merge makes a pair that is as good
        as the one just merged, the order of single merges matters: that word is
        finished one merge at a time, as are words of more than LONG symbols.
        """
        word = np.repeat(np.arange(len(lengths)), lengths)
        done_sym, done_word = [], []

        def finish(words: np.ndarray) -> None:
            # Words are in order, so each stands in one slice.
            lo, hi = np.searchsorted(word, words), np.searchsorted(word, words, side="right")
            for w, a, b in zip(words.tolist(), lo.tolist(), hi.tolist(), strict=True):
                out = self.merge_one(sym[a:b])
                done_sym.append(np.array(out, dtype=np.int64))
                done_word.append(np.full(len(out), w))

        if (lengths > LONG).any():
            finish(np.flatnonzero(lengths > LONG))
            short = np.repeat(lengths <= LONG, lengths)
            sym, word = sym[short], word[short]
        # The merge of each symbol with the next one of its word. A round looks up only the pairs that it has made.
        made = np.full(len(sym), -1, dtype=np.int32)
        if len(sym) > 1:
            made[:-1] = np.where(word[:-1] == word[1:], self.joined(sym[:-1], sym[1:]), -1)
        rank_at = np.where(made >= 0, self.rank[made], NO_RANK)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[:-1] != word[1:]])
            best = np.minimum.reduceat(rank_at, starts)
            counts = np.diff(np.r_[starts, len(sym)])
            best_at = np.repeat(best, counts)
            live = best_at < NO_RANK
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                if not live.any():
                    break
                keep = np.flatnonzero(live)
                # Words leave whole, so pairs inside the rest stay neighbours.
                sym, word, rank_at, best_at, made = sym[keep], word[keep], rank_at[keep], best_at[keep], made[keep]
            hit = rank_at == best_at
            if (hit[:-1] & hit[1:]).any():
                # In a run of touching hits every second one merges, counted from the left.
                index = np.arange(len(hit))
                run_start = hit & ~np.r_[False, hit[:-1]]
                run_base = np.maximum.accumulate(np.where(run_start, index, 0))
                hit &= (index - run_base) % 2 == 0
            merged = np.flatnonzero(hit)
            kept = np.ones(len(hit), dtype=bool)
            kept[merged + 1] = False
            new = sym.copy()  # words that are finished below start from what stands here now
            new[merged] = self.piece[made[merged]]
            # What stands behind a merged pair stands behind its piece now.
            made[merged], rank_at[merged] = made[merged + 1], rank_at[merged + 1]
            new, new_word, new_hit, old_best, made, rank_at = new[kept], word[kept], hit[kept], best_at[kept], made[kept], rank_at[kept]
            pair = (new_word[:-1] == new_word[1:]) & (new_hit[:-1] | new_hit[1:])
            at = np.flatnonzero(pair)
            if len(at):
                fresh = made[at] = self.joined(new[at], new[at + 1])
                rank_at[at] = np.where(fresh >= 0, self.rank[fresh], NO_RANK)
                bad = at[(fresh >= 0) & (self.rank[fresh] <= old_best[at])]
                if len(bad):
                    slow = np.unique(new_word[bad])
                    finish(slow)
                    keep = ~np.isin(new_word, slow)
                    new, new_word, made, rank_at = new[keep], new_word[keep], made[keep], rank_at[keep]
            sym, word = new, new_word
        if not done_sym:
            return np.zeros(0, dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(lengths))

    @cached_property
    def by_pair(self) -> dict[tuple[int, int], tuple[int, int]]:
        """Rank and piece by pair, for words that are merged one step at a time."""
        pairs, made = zip(self.left.tolist(), self.right.tolist(), strict=True), zip(self.rank.tolist(), self.piece.tolist(), strict=True)
        return dict(zip(pairs, made, strict=True))

    def merge_one(self, sym: np.ndarray) -> list[int]:
        """One word's merges, one at a time: best rank first, then from the left. Its cost grows with n log n."""
        n, known = len(sym), self.by_pair
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        made = self.joined(sym[:-1], sym[1:])
        at = np.flatnonzero(made >= 0)
        heap = list(zip(self.rank[made[at]].tolist(), at.tolist(), sym[at].tolist(), sym[at + 1].tolist(), self.piece[made[at]].tolist(), strict=True))
        heapq.heapify(heap)
        sym = sym.tolist()

        def offer(i: int) -> None:
            j = nxt[i] if i >= 0 else n
            found = known.get((sym[i], sym[j])) if i >= 0 and j < n else None
            if found:
                heapq.heappush(heap, (found[0], i, sym[i], sym[j], found[1]))

        alive = [True] * n
        while heap:
            _, i, a, b, piece = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i] = piece
            alive[j] = False
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            offer(prv[i])
            offer(i)
        return [s for s, a in zip(sym, alive, strict=True) if a]
