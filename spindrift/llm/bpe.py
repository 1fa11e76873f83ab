"""BPE by speculation and verification.

Greedy longest match proposes the tokens of each new word. A proposal is the exact result of merging if, and only if, each of its tokens is what its own characters merge to and no merge ever joins two neighbouring tokens across their border. The first is settled once for the vocabulary. The second is checked for all neighbours of all new words of a batch at once, with numpy: both tokens are taken apart in step, always the one that was formed later, and at each step the two parts at the border must have no merge that comes before those which took them into their tokens. Only words with a failing pair undergo exact merging.

All three steps run over the new words of a batch together, in numpy: the match walks a trie for all words at once, and merging takes the earliest merge of every failing word at each step. Words of over `LONG` characters take the same three steps each on their own, over a heap, so memory stays linear in a word of any length.

Words come from the tokenizer file's own normalizer and split pattern: `tokens.cut` follows it for common characters, other chunks go through the library's parts. A worker keeps the ids of words it has met, a bounded number of them, compared byte by byte. Decoding maps ids to their token strings and joins them as the library does without a decoder. Texts with white space beyond ASCII that the first family must see whole, and tokenizers of any other make, go to the library.

Defined results: null text counts as empty, with no ids and an empty decoded text; repeated rows each get their row; a null doc_id keeps its row; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

NEVER = np.int64(1) << 40
#: Characters of a word that still shares the numpy steps of its batch.
LONG = 64
#: Bytes of texts that are cut into words together, and words that are merged together.
TOGETHER, TOGETHER_WORDS = 500_000, 4096


class Table:
    """Values of integer keys, none negative, looked up for whole arrays (open addressing)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.last, self.missing = np.uint64(64 - bits), (1 << bits) - 1, missing
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, missing, np.int64)
        keys = np.asarray(keys, np.int64)
        left, at = np.arange(len(keys)), self.home(keys)
        while len(left):
            free = left[self.keys[at[left]] < 0]
            slot, who = np.unique(at[free], return_index=True)
            self.keys[slot], self.values[slot] = keys[free[who]], values[free[who]]
            left = np.setdiff1d(left, free[who])
            at[left] = (at[left] + 1) & self.last

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = self.home(keys)
        there, out = self.keys[at], self.values[at]
        left = np.nonzero(there != keys)[0]
        out[left] = self.missing
        left = left[there[left] >= 0]
        while len(left):
            at[left] = (at[left] + 1) & self.last
            there = self.keys[at[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out


    def one(self, key: int) -> int:
        """The value of a single key."""
        at = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
        while (there := self.keys.item(at)) != key:
            if there < 0:
                return self.missing
            at = (at + 1) & self.last
        return self.values.item(at)


class Merges:
    """A vocabulary's merges, as tables for checks on arrays. Words are arrays of letters: places in `letters`, the vocabulary's single characters."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.vocab, self.suffix = vocab, suffix
        size = max(vocab.values()) + 1
        self.rank = np.full(size, -1, np.int64)  # -1: a character, there from the start
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.join: dict[tuple[int, int], tuple[int, int]] = {}
        made_twice = set()
        for rank, (a, b) in enumerate(merges):
            whole = vocab[a + b]
            self.join[vocab[a], vocab[b]] = (rank, whole)
            if self.rank[whole] >= 0:
                made_twice.add(whole)
            else:
                self.rank[whole], self.left[whole], self.right[whole] = rank, vocab[a], vocab[b]
        self.ranks = Table(np.array([a << 32 | b for a, b in self.join], np.int64), np.array([r for r, _ in self.join.values()], np.int64), int(NEVER))
        self.whole = np.array([vocab[a + b] for a, b in merges], np.int64)
        made = np.nonzero(self.rank >= 0)[0]
        #: Whether parts always come before wholes; if not, no proposal is taken on trust.
        self.ordered = bool((self.rank[made] > np.maximum(self.rank[self.left[made]], self.rank[self.right[made]])).all())
        sound = np.ones(size, bool)
        sound[list(made_twice)] = False
        sound[made] &= self.apart(self.left[made], self.right[made], skip_first=True)
        for t in made[np.argsort(self.rank[made])].tolist():
            sound[t] &= sound[self.left[t]] and sound[self.right[t]]
        self.letters = sorted({c for t in vocab for c in (t.removesuffix(suffix) if suffix else t)})
        self.place = {c: i for i, c in enumerate(self.letters)}
        self.end = len(self.letters)  # the letter after a word's last one, where tokens have a suffix
        self.single = np.array([vocab.get(c, -1) for c in self.letters] + [-1], np.int64)
        self.final = np.array([vocab.get(c + suffix, -1) for c in self.letters] + [-1], np.int64)
        self._trie({text: i for text, i in vocab.items() if sound[i]})

    def _trie(self, known: dict[str, int]) -> None:
        """next[node * width + letter]: the node after a letter, 0 without; token[node]: its token or -1; the root is node 1. Nodes without further letters come last, from `leaf` on."""
        self.width = self.end + 1
        steps: dict[int, int] = {}
        token = [-1, -1]
        for text, i in known.items():
            bare = text.removesuffix(self.suffix) if self.suffix else text
            at = 1
            for x in [self.place[c] for c in bare] + ([self.end] if self.suffix and bare != text else []):
                nxt = steps.get(at * self.width + x)
                if nxt is None:
                    nxt = steps[at * self.width + x] = len(token)
                    token.append(-1)
                at = nxt
            token[at] = i
        keys, nodes = np.array(list(steps), np.int64), np.array(list(steps.values()), np.int64)
        inner = np.zeros(len(token), bool)
        inner[[0, 1]] = True
        inner[keys // self.width] = True
        order = np.argsort(~inner, kind="stable")
        name = np.empty(len(token), np.int64)
        name[order] = np.arange(len(token))
        self.leaf, self.token = int(inner.sum()), np.array(token, np.int64)[order]
        self.next = Table(name[keys // self.width] * self.width + keys % self.width, name[nodes], 0)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.ranks[a << 32 | b]

    def apart(self, a: np.ndarray, b: np.ndarray, skip_first: bool = False) -> np.ndarray:
        """Whether merging never joins the end of token a with the start of token b next to it."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        good, live = np.ones(len(a), bool), np.arange(len(a))
        a_taken, b_taken = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(live):
            if not skip_first:
                rank = self.rank_of(a, b)
                bad = (rank < a_taken) & (rank <= b_taken)  # of equal merges the one further left comes first
                good[live[bad]] = False
            else:
                bad = np.zeros(len(a), bool)
            skip_first = False
            ra, rb = self.rank[a], self.rank[b]
            on = ~bad & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb, a_taken, b_taken = (x[on] for x in (live, a, b, ra, rb, a_taken, b_taken))
            first = ra > rb
            a_taken, b_taken = np.where(first, ra, a_taken), np.where(first, b_taken, rb)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return good

    def proposals(self, letters: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest match of words at [start, end) of letters: word and token of each match, in order, and which words have none for some letter. Where tokens have a suffix, letters[end] must be self.end."""
        extra = 1 if self.suffix else 0
        owners, found, lost = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(start), bool)
        live, at = np.nonzero(start < end)[0], start.copy()
        while len(live):
            stop, best, to = end[live] + extra, np.full(len(live), -1, np.int64), at[live]
            some, q, node = np.arange(len(live)), to.copy(), np.ones(len(live), np.int64)
            while len(some):
                node = self.next[node * self.width + letters[q]]
                on = node > 0
                some, q, node = some[on], q[on] + 1, node[on]
                token = self.token[node]
                good = token >= 0
                if extra:
                    good &= q != stop[some] - 1  # the last letter goes with the end
                best[some[good]], to[some[good]] = token[good], q[good]
                on = (node < self.leaf) & (q < stop[some])
                some, q, node = some[on], q[on], node[on]
            hit = best >= 0
            lost[live[~hit]] = True
            owners.append(live[hit])
            found.append(best[hit])
            at[live] = to
            live = live[hit & (to < stop)]
        owner, token = np.concatenate(owners), np.concatenate(found)
        order = np.argsort(owner, kind="stable")
        return owner[order], token[order], lost

    def merged(self, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Exact merging of words of at least one token, a row each, padded with -1: the earliest merge first, of equal ones the one further left. Tokens that are left, others -1."""
        n, width = first.shape
        token, rank = first.copy(), np.full((n, width), NEVER)
        place = np.arange(width)
        after, before = np.tile(place + 1, (n, 1)), np.tile(place - 1, (n, 1))
        i, j = np.nonzero(place[None, 1:] < size[:, None])
        rank[i, j] = self.rank_of(token[i, j], token[i, j + 1])
        live = np.arange(n)
        while True:
            rows = rank[live]
            at = rows.argmin(axis=1)
            best = rows[np.arange(len(live)), at]
            on = best < NEVER
            live, at, best = live[on], at[on], best[on]
            if not len(live):
                return token
            gone = after[live, at]
            whole, nxt = self.whole[best], after[live, gone]
            token[live, at], after[live, at] = whole, nxt
            token[live, gone], rank[live, gone] = -1, NEVER
            rank[live, at] = NEVER
            has = nxt < size[live]
            r, a, x = live[has], at[has], nxt[has]
            before[r, x] = a
            rank[r, a] = self.rank_of(whole[has], token[r, x])
            x = before[live, at]
            has = x >= 0
            r, x = live[has], x[has]
            rank[r, x] = self.rank_of(token[r, x], whole[has])

    def merged_one(self, parts: list[int]) -> list[int]:
        """The same for a single word of any length."""
        last = len(parts)
        token, after, before = list(parts), list(range(1, last + 1)), list(range(-1, last - 1))
        heap = [(self.join[pair][0], i, pair) for i, pair in enumerate(zip(parts, parts[1:], strict=False)) if pair in self.join]
        heapq.heapify(heap)
        while heap:
            _, at, pair = heapq.heappop(heap)
            gone = after[at]
            if token[at] != pair[0] or gone >= last or token[gone] != pair[1]:
                continue
            token[at], token[gone], after[at] = self.join[pair][1], -1, after[gone]
            if after[at] < last:
                before[after[at]] = at
            for a, b in ((before[at], at), (at, after[at])):
                if a >= 0 and b < last and (pair := (token[a], token[b])) in self.join:
                    heapq.heappush(heap, (self.join[pair][0], a, pair))
        return [t for t in token if t >= 0]

    def spelled(self, word: str) -> np.ndarray:
        """A word's letters, with the end where tokens have a suffix; -1 for unknown ones."""
        return np.array([self.place.get(c, -1) for c in word] + [self.end] * bool(self.suffix), np.int64)

    def characters(self, letters: np.ndarray) -> list[int]:
        """The tokens of a word's letters before any merge; unknown ones are dropped."""
        if self.suffix:
            letters = letters[:-1]
        out = self.single[letters]
        if self.suffix and len(out):
            out[-1] = self.final[letters[-1]]
        return out[(letters >= 0) & (out >= 0)].tolist()

    def propose(self, word: str) -> list[int] | None:
        """Greedy longest match; None where a letter has no token."""
        letters = self.spelled(word)
        if (letters < 0).any():
            return None
        return self._proposed(letters.tolist())

    def _proposed(self, letters: list[int]) -> list[int] | None:
        out, at, stop = [], 0, len(letters)
        last = stop - 1 if self.suffix else -1
        if at == last:
            return out
        while at < stop:
            node, q, best, to = 1, at, -1, at
            while node < self.leaf and q < stop and (node := self.next.one(node * self.width + letters[q])):
                q += 1
                if self.token[node] >= 0 and q != last:
                    best, to = int(self.token[node]), q
            if best < 0:
                return None
            out.append(best)
            at = to
        return out

    def merge(self, word: str) -> list[int]:
        """Exact merging; unknown characters are dropped."""
        return self.merged_one(self.characters(self.spelled(word)))

    def _one(self, letters: np.ndarray) -> list[int]:
        found = self._proposed(letters.tolist()) if self.ordered and (letters >= 0).all() else None
        if found is None or not self.apart(np.array(found[:-1], np.int64), np.array(found[1:], np.int64)).all():
            return self.merged_one(self.characters(letters))
        return found

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of words in characters of the vocabulary."""
        parts = [self.spelled(w) for w in words]
        extra = 1 if self.suffix else 0
        token, counts = self.ids(np.concatenate([*parts, np.zeros(0, np.int64)]), np.array([len(p) - extra for p in parts], np.int64))
        return [x.tolist() for x in np.split(token, np.cumsum(counts)[:-1])] if words else []

    def ids(self, letters: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after another, and how many each has. The words' letters stand one after another, the end of each included where tokens have a suffix, which its size does not count."""
        extra = 1 if self.suffix else 0
        start = np.cumsum(size + extra) - size - extra
        unknown = np.zeros(len(size), bool)
        unknown[np.searchsorted(start, np.nonzero(letters < 0)[0], "right") - 1] = True
        alone = (size > LONG) | unknown
        some = np.nonzero(~alone & (size > 0))[0]
        owner, token, lost = self.proposals(letters, start[some], start[some] + size[some])
        fails = lost if self.ordered else np.ones(len(some), bool)
        inside = np.nonzero(owner[1:] == owner[:-1])[0]
        fails[owner[inside][~self.apart(token[inside], token[inside + 1])]] = True
        good = ~fails[owner]
        owners, found = [some[owner[good]]], [token[good]]
        wrong = some[fails]
        wrong = wrong[np.argsort(size[wrong], kind="stable")]
        for low, high in ((0, 8), (8, 16), (16, 32), (32, LONG)):
            part = wrong[(size[wrong] > low) & (size[wrong] <= high)]
            for at in range(0, len(part), TOGETHER_WORDS):
                rows = part[at : at + TOGETHER_WORDS]
                place = np.arange(int(size[rows].max()))
                there = place < size[rows, None]
                spelling = letters[np.minimum(start[rows, None] + place, len(letters) - 1)]
                first = np.where(there, self.single[spelling], -1)
                if extra:
                    each = np.arange(len(rows))
                    first[each, size[rows] - 1] = self.final[spelling[each, size[rows] - 1]]
                bad = (there & (first < 0)).any(axis=1)  # a letter without a token of its own
                alone[rows[bad]] = True
                rows, left = rows[~bad], self.merged(first[~bad], size[rows[~bad]])
                i, j = np.nonzero(left >= 0)
                owners.append(rows[i])
                found.append(left[i, j])
        for i in np.nonzero(alone & (size > 0))[0].tolist():
            one = self._one(letters[start[i] : start[i] + size[i] + extra])
            owners.append(np.full(len(one), i))
            found.append(np.array(one, np.int64))
        owner, token = np.concatenate(owners), np.concatenate(found)
        return token[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(size))


class Known:
    """The ids of units met before. Words of up to 32 bytes are found by arrays: their bytes in four lanes, by open addressing; other units by a dictionary."""

    LANES = 4

    def __init__(self) -> None:
        self.n = self.n_ids = self.n_words = 0
        self.lanes, self.size = np.zeros((1 << 14, self.LANES), np.uint64), np.zeros(1 << 14, np.int64)
        self.at, self.count, self.ids = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), np.zeros(1 << 16, np.uint32)
        self.others: dict[bytes, int] = {}
        self._room(1 << 15)

    def _room(self, slots: int) -> None:
        self.table, self.shift = np.full(slots, -1, np.int32), np.uint64(64 - slots.bit_length() + 1)

    @staticmethod
    def mixed(lanes: np.ndarray, size: np.ndarray) -> np.ndarray:
        h = size.astype(np.uint64)
        for k in range(lanes.shape[1]):
            h = (h ^ lanes[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h * np.uint64(0xBF58476D1CE4E5B9)

    def find(self, lanes: np.ndarray, size: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """Numbers of words, -1 for unknown ones."""
        out, left, at = np.full(len(size), -1, np.int64), np.arange(len(size)), (mixed >> self.shift).astype(np.int64)
        while len(left):
            k = self.table[at[left]]
            there = k >= 0
            same = there & (self.size[k] == size[left])
            same &= (self.lanes[k] == lanes[left]).all(axis=1)
            out[left[same]] = k[same]
            left = left[there & ~same]
            at[left] = (at[left] + 1) & (len(self.table) - 1)
        return out

    def add(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Keeps the ids of new units; their numbers."""
        new = np.arange(self.n, self.n + len(counts))
        while len(self.at) < self.n + len(counts):
            self.lanes, self.size, self.at, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.lanes, self.size, self.at, self.count))
        while len(self.ids) < self.n_ids + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.at[new], self.count[new], self.size[new] = self.n_ids + np.cumsum(counts) - counts, counts, -1
        self.n += len(counts)
        self.n_ids += len(ids)
        return new

    def add_words(self, lanes: np.ndarray, size: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Keeps words, all unlike."""
        new = self.add(ids, counts)
        self.lanes[new], self.size[new] = lanes, size
        self.n_words += len(new)
        if 2 * self.n_words > len(self.table):
            slots = len(self.table)
            while 2 * self.n_words > slots:
                slots *= 2
            self._room(slots)
            new = np.nonzero(self.size[: self.n] >= 0)[0]
        left, at = new, (self.mixed(self.lanes[new], self.size[new]) >> self.shift).astype(np.int64)
        while len(left):
            free = np.nonzero(self.table[at] < 0)[0]
            slot, who = np.unique(at[free], return_index=True)
            self.table[slot] = left[free[who]]
            on = np.ones(len(left), bool)
            on[free[who]] = False
            left, at = left[on], (at[on] + 1) & (len(self.table) - 1)


class Codec:
    """encode and decode whole texts as the library does with this file."""

    def __init__(self, path: str, most: int = 480_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.library, model = Tokenizer.from_file(path), made["model"]
        self.library.no_truncation()
        self.library.no_padding()
        self.kind = tokens.family(made)
        self.special = {t["content"]: t["id"] for t in made.get("added_tokens", [])}
        self.marks = re.compile("|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.names: list[bytes] = []
        if self.kind:
            pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            self.merges = Merges(model["vocab"], pairs, model.get("end_of_word_suffix") or "")
            self.of_byte = np.array([self.merges.place.get(c, -1) for c in tokens.BYTE_LETTERS], np.int64)
            names = model["vocab"] | self.special
            self.names = [b""] * (max(names.values()) + 1)
            for text, i in names.items():
                self.names[i] = text.encode()
        self.has_decoder = made.get("decoder") is not None
        self.most, self.known = most, Known()

    def parts(self, text: str) -> list[bytes | int]:
        """The words, as bytes, and special ids of a chunk."""
        out: list[bytes | int] = []
        at = 0
        for m in [*(self.marks.finditer(text) if self.marks else ()), None]:
            piece = text[at : m.start() if m else None]
            if piece:
                piece = self.library.normalizer.normalize_str(piece) if self.library.normalizer else piece
                out += [tokens.spelled(w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(piece)]
            if m:
                out.append(self.special[m[0]])
                at = m.end()
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as uint32 bytes."""
        return self.encode_column(pa.array(texts, pa.large_string()))

    def encode_column(self, column: pa.Array) -> list[bytes]:
        """Ids of each text of an Arrow column, as uint32 bytes; null is an empty text."""
        column = (column.fill_null("") if column.null_count else column).cast(pa.large_string())
        if not self.kind:
            return self._whole(column.to_pylist())
        if not len(column):
            return []
        _, offsets, data = column.buffers()
        rows = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(data, np.uint8)[rows[0] : rows[-1]] if data else np.zeros(0, np.uint8)
        bounds, owner = tokens.divided(data, rows - rows[0])
        out: list[list[bytes]] = [[] for _ in range(len(column))]
        at = 0
        while at < len(owner):  # some pieces together
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + TOGETHER, "right")) - 1)
            for i, ids in zip(owner[at:to].tolist(), self._pieces(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]), strict=True):
                out[i].append(ids)
            at = to
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, data: np.ndarray, rows: np.ndarray) -> list[bytes]:
        if not len(data):
            return [b""] * (len(rows) - 1)
        if self.known.n + len(self.known.others) > self.most:
            self.known = Known()
        known = self.known
        low, start, end, odd = tokens.cut(data, rows, self.kind)
        size = end - start
        plain = ~odd & (size <= 8 * known.LANES)
        number, alone = np.zeros(len(start), np.int64), []
        words = np.nonzero(plain)[0]
        number[words] = self._words(low, start[words], size[words])
        for i in np.nonzero(~plain)[0].tolist():
            a, b = int(start[i]), int(end[i])
            unit = (data if odd[i] else low)[a:b].tobytes()
            if (k := known.others.get(unit)) is None:
                k = known.others[unit] = self._other(unit, bool(odd[i]))
            number[i] = k
            if k < 0:
                alone.append(int(np.searchsorted(rows, a, "right")) - 1)
        counts = known.count[number]
        places = np.append(0, np.cumsum(counts))
        flat = known.ids[np.repeat(known.at[number] - places[:-1], counts) + np.arange(places[-1])].astype("<u4").tobytes()
        cuts = (4 * places[np.searchsorted(start, rows)]).tolist()
        out = [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        if alone:
            alone = sorted(set(alone))
            for i, ids in zip(alone, self._whole([data[rows[i] : rows[i + 1]].tobytes().decode() for i in alone]), strict=True):
                out[i] = ids
        return out

    def _words(self, low: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of words of up to 32 bytes; new ones are encoded together."""
        known = self.known
        padded = np.concatenate([low, np.zeros(8 * known.LANES, np.uint8)])
        eight = np.ndarray((len(low) + 8 * known.LANES - 7,), "<u8", padded, strides=(1,))
        lanes = np.zeros((len(start), known.LANES), np.uint64)
        for k in range(known.LANES):
            some = np.nonzero(size > 8 * k)[0] if k else slice(None)
            left = np.clip(size[some] - 8 * k, 0, 8)
            lanes[some, k] = eight[start[some] + 8 * k] & MASKS[left]
        mixed = known.mixed(lanes, size)
        number = known.find(lanes, size, mixed)
        while len(new := np.nonzero(number < 0)[0]):
            one = new[np.unique(mixed[new], return_index=True)[1]]  # of unlike words of one hash the others come next
            extra = 1 if self.merges.suffix else 0
            n = size[one] + extra
            place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            letters = self.of_byte[padded[np.repeat(start[one], n) + place]]
            if extra:
                letters[np.cumsum(n) - 1] = self.merges.end
            known.add_words(lanes[one], size[one], *self.merges.ids(letters, size[one]))
            number[new] = known.find(lanes[new], size[new], mixed[new])
        return number

    def _other(self, unit: bytes, odd: bool) -> int:
        """Number of a long word or an odd chunk; -1 if the chunk must be seen with its neighbours."""
        parts: list[bytes | int] = [unit]
        if odd:
            text = unit.decode()
            bare = text.removeprefix(" ")
            if self.kind == "spaced" and (bare[0].isspace() or bare[-1].isspace() or bare.startswith(tuple(self.special))):
                return -1
            parts = self.parts(text)
        found = [np.array([p]) if isinstance(p, int) else self._long(p) for p in parts]
        ids = np.concatenate([*found, np.zeros(0, np.int64)])
        return int(self.known.add(ids, np.array([len(ids)]))[0])

    def _long(self, word: bytes) -> np.ndarray:
        letters = self.of_byte[np.frombuffer(word, np.uint8)]
        return self.merges.ids(np.append(letters, self.merges.end) if self.merges.suffix else letters, np.array([len(word)]))[0]

    def decode(self, packed: bytes) -> bytes:
        """The text, as UTF-8."""
        ids = tokens.ids_of(packed).tolist()
        if self.has_decoder or not self.kind:
            return self.library.decode(ids, skip_special_tokens=False).encode("utf-8", "surrogatepass")
        return b" ".join(map(self.names.__getitem__, ids))


#: The lowest bytes of a lane, by their number.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One for each file and worker process."""
    return Codec(path)


def round_trip(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of docs(doc_id, text)."""
    path = tokenizer_path or tokens.public_path("word_bpe_49k.json")
    common.short_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            encoded = own.encode_column(b.column(1))
            sha = [hashlib.sha256(x).hexdigest() for x in encoded]
            back = [hashlib.sha256(own.decode(x)).hexdigest() for x in encoded]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in encoded], pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(common.released(rows), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row of docs(doc_id, text)."""
    path = tokenizer_path or tokens.public_path("word_bpe_49k.json")
    common.short_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            encoded = own.encode_column(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([tokens.ids_of(x).view(np.int32) for x in encoded], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(common.released(rows), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, text) from encoded(doc_id, ids)."""
    path = tokenizer_path or tokens.public_path("word_bpe_49k.json")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            texts = [None if x is None else own.decode(np.array(x, "<u4").tobytes()).decode() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(common.released(rows), "doc_id long, text string")
