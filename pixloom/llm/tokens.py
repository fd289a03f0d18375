"""Token ids of a byte-level BPE vocabulary for whole Arrow columns of texts.

The library's BPE works on one pre-token at a time, so only the distinct pre-tokens of a batch are
given to it; where pre-tokens begin and end is found for all texts at once from the classes of their
characters, and those classes are asked of the library's own pre-tokenizer.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from pixloom.llm.text import CHUNK, Stretch, mix, ragged

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
BREAK = 5  # the end of a text
CACHED = 1 << 20  # pre-tokens kept between batches
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")  # after an apostrophe; fixed values
CUT = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")


class Encoder:
    """``encode(texts)`` gives all ids and the offsets of the texts in them; nulls are empty."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        state = self.model.pre_tokenizer.__getstate__()
        plain = b'"ByteLevel"' in state and b'"add_prefix_space":false' in state.replace(b" ", b"")
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        if not plain or self.model.normalizer is not None:
            raise ValueError(f"{path} is no byte-level vocabulary without a prefix space")
        self.kinds = np.zeros(0x110000, np.uint8)
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)  # hashes, ascending
        self.at, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def classify(self, points: np.ndarray) -> np.ndarray:
        kinds = self.kinds[points]
        if not kinds.all():
            together = lambda s: len(self.model.pre_tokenizer.pre_tokenize_str(s)) == 1
            for c in np.unique(points[kinds == 0]).tolist():
                x = chr(c)
                tests = ((LETTER, "a" + x), (NUMBER, "1" + x), (OTHER, "!" + x))
                self.kinds[c] = next((k for k, s in tests if together(s)), SPACE)
            kinds = self.kinds[points]
        return kinds

    def starts(self, points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Whether a pre-token begins at each code point."""
        n = len(points)
        kind = np.full(n + 1, BREAK, np.uint8)
        kind[:n] = self.classify(points)
        first = np.zeros(n + 1, bool)  # of a text
        first[bounds] = True
        begin = first.copy()
        begin[1:n] |= kind[1:n] != kind[: n - 1]
        # the last white space before a word is a pre-token of its own or, as a blank, part of the word's
        word = np.flatnonzero(begin[:n] & ~first[:n] & (kind[:n] != SPACE))
        after = word[kind[word - 1] == SPACE]
        begin[after - 1] = True
        begin[after[points[after - 1] == 0x20]] = False
        # an apostrophe that begins a pre-token takes one of the endings with it
        mark = np.flatnonzero((points == 0x27) & begin[:n])
        for ending in sorted(ENDINGS, key=len):
            width = len(ending)
            some = mark[mark + width < n]
            fits = begin[some + 1] & ~first[some + 1]
            for i, c in enumerate(ending):
                fits &= (points[some + 1 + i] == ord(c)) & ~first[some + 1 + i]
            some = some[fits]
            end = some + 1 + width
            begin[some + 1] = False
            begin[end] |= kind[end] == LETTER
        return begin[:n]

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Places in the cache; -1 where it has none."""
        if not len(self.known):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at, -1)

    def some(self, points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts given by code points, and how many each has."""
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(bounds) - 1, np.int64)
        begin = np.flatnonzero(self.starts(points, bounds))
        end = np.append(begin[1:], len(points))
        hashes, first, inverse = np.unique(
            Stretch(mix(points.astype(np.uint64) + np.uint64(1))).of(begin, end), return_index=True, return_inverse=True
        )
        new = np.flatnonzero(self.look_up(hashes) < 0)
        if len(new):
            if len(self.known) + len(new) > CACHED:
                self.clear()
                new = np.arange(len(hashes))
            words = [points[begin[i] : end[i]].astype("<u4").tobytes().decode("utf-32-le") for i in first[new]]
            ids = [e.ids for e in self.model.encode_batch_fast(words, add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            at = len(self.flat) + np.cumsum(sizes) - sizes
            self.flat = np.concatenate([self.flat, np.fromiter((x for one in ids for x in one), np.int32, int(sizes.sum()))])
            known = np.concatenate([self.known, hashes[new]])
            order = np.argsort(known, kind="stable")
            self.known = known[order]
            self.at, self.size = np.concatenate([self.at, at])[order], np.concatenate([self.size, sizes])[order]
        place = self.look_up(hashes)[inverse]
        sizes = self.size[place]
        total = np.zeros(len(begin) + 1, np.int64)
        np.cumsum(sizes, out=total[1:])
        text = np.searchsorted(begin, bounds)
        return self.flat[ragged(self.at[place], sizes)], total[text[1:]] - total[text[:-1]]

    def parts(self, text: str):
        """A long text in stretches that end between a word and a blank, where pre-tokens end too."""
        at = 0
        while len(text) - at > CHUNK:
            found = CUT.search(text, at + CHUNK)
            if not found:
                break
            yield text[at : found.start()]
            at = found.start()
        yield text[at:]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = [t or "" for t in column.to_pylist()]
        if any(s in t for s in self.special for t in texts):  # kept whole by the library alone
            each = [np.array(e.ids, np.int32) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
            counts = np.array([len(e) for e in each], np.int64)
            ids = np.concatenate(each)
        else:
            out, counts, owner, group, size = [], np.zeros(len(texts), np.int64), [], [], 0

            def flush():
                points = np.frombuffer("".join(group).encode("utf-32-le"), np.uint32)
                bounds = np.zeros(len(group) + 1, np.int64)
                np.cumsum([len(g) for g in group], out=bounds[1:])
                ids, sizes = self.some(points, bounds)
                out.append(ids)
                np.add.at(counts, owner, sizes)
                group.clear()
                owner.clear()

            for i, text in enumerate(texts):
                for part in self.parts(text):
                    group.append(part)
                    owner.append(i)
                    size += len(part)
                    if size >= CHUNK:
                        flush()
                        size = 0
            flush()
            ids = np.concatenate(out)
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(counts, out=offsets[1:])
        return ids, offsets
