"""Token ids of whole texts by a public ``tokenizers`` vocabulary.

The vocabulary drops white space and its pieces never span it, so the ids of
a text are those of its parts between blanks, in order; nor do pieces span the
border from a letter or digit to a run of marks, so a part's closing marks are
encoded apart.  Parts are found and told apart column by column (numpy, Arrow);
only different words meet Python, and only those that the worker hasn't kept
meet the library.  New words that are letters only are encoded many at a time:
each of them is one piece, whose last token the vocabulary marks with
``</w>``, so the ids are cut there; other words, and those of a text whose
numbers of pieces and words differ, stand between special tokens.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker keeps (about 200 bytes each); beyond, only those of the portion at hand stay.
KEEP = 400_000
#: As many, where a worker holds other things too.
FEW = 100_000
#: A word of more bytes is encoded but not kept.
LONG = 128
#: Words that are encoded as one text.
JOINED = 256
#: Bytes of text that are encoded at a time.
PORTION = 4 << 20
#: Marks that are taken off a part's end at most; a part with more is one word.
_MARKS = 8
_ENCODERS: dict = {}


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_BLANK, _CLOSING = _table(b" \n"), _table(b".,;:!?)")
_ALNUM = _table(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


class WordEncoder:
    """Encodes columns of texts to unsigned 32-bit ids."""

    def __init__(self, path: str, keep: int | None = None):
        self.keep = keep
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        # a special token cuts a text, so words with it between them are encoded apart
        self.cut = next((t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special and not t.lstrip and not t.rstrip), None)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of new words."""
        out, plain, single = {}, [], []
        for w in words:
            (plain if w.isalpha() or w.decode().isalpha() else single).append(w)
        groups = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        for group, ids in zip(groups, self._ids([b" ".join(g).decode() for g in groups])):
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cuts) != len(group) or cuts[-1] != 4 * len(ids):
                single += group
                continue
            raw, at = ids.tobytes(), 0
            for w, end in zip(group, cuts.tolist()):
                out[w] = raw[at:end]
                at = end
        alone = [w for w in single if self.cut is None or b"<" in w]
        out.update(zip(alone, (i.tobytes() for i in self._ids([w.decode() for w in alone]))))
        rest = [w for w in single if w not in out]
        groups = [rest[i : i + JOINED] for i in range(0, len(rest), JOINED)]
        for group, ids in zip(groups, self._ids([self.cut.join(w.decode() for w in g) for g in groups])):
            edges = [-1, *np.flatnonzero(ids == self.tokenizer.token_to_id(self.cut)).tolist(), len(ids)]
            out.update((w, ids[a + 1 : z].tobytes()) for w, a, z in zip(group, edges, edges[1:]))
        return out

    def _words(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Words and closing marks, in turns, of adjoining texts in one buffer,
        and the number of the first part of each text.  ASCII is in lower case."""
        blanks = np.flatnonzero(_BLANK[text])
        first = np.searchsorted(blanks, starts) + np.arange(len(starts))
        a = np.sort(np.concatenate([starts, blanks + 1]), kind="stable")
        z = np.sort(np.concatenate([blanks, ends]), kind="stable")
        stem, some = z.copy(), np.arange(len(a))
        for _ in range(_MARKS):
            some = some[stem[some] > a[some]]
            some = some[_CLOSING[text[stem[some] - 1]]]
            stem[some] -= 1
        # marks are cut off only where a letter or digit stands before them
        whole = stem == a
        whole |= ~_ALNUM[text[np.maximum(stem, 1) - 1]] if len(text) else False
        stem = np.where(whole, z, stem)
        own = text[~_BLANK[text]]
        low = _LOWER[own]
        size = z - a
        at = np.concatenate([[0], np.cumsum(size)])
        # what has a < may be a special token, which is told by its case
        for k in np.unique(np.searchsorted(at, np.flatnonzero(own == 60), side="right") - 1).tolist():
            low[at[k] : at[k + 1]] = own[at[k] : at[k + 1]]
        edges = np.empty(2 * len(a) + 1, dtype=np.int32)
        edges[0:-1:2], edges[1::2], edges[-1] = at[:-1], at[:-1] + (stem - a), at[-1]
        return pa.Array.from_buffers(pa.binary(), 2 * len(a), [None, pa.py_buffer(edges), pa.py_buffer(low)]), first

    def _encode(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of adjoining texts, and where each one's start and the last ends."""
        words, first = self._words(text, starts, ends)
        coded = words.dictionary_encode()
        unlike = coded.dictionary.to_pylist()
        found = list(map(self.known.get, unlike))
        new = [w for w, i in zip(unlike, found) if i is None]
        if new:
            got = self._learn(new)
            found = [got[w] if i is None else i for w, i in zip(unlike, found)]
            if len(self.known) + len(new) > (self.keep or KEEP):
                self.known = dict(zip(unlike, found))
            else:
                self.known.update(got)
            for w in new:
                if len(w) > LONG:
                    self.known.pop(w, None)
        ids = pa.array(found, pa.large_binary()).take(coded.indices)
        _, offsets, data = ids.buffers()
        edges = np.frombuffer(offsets, np.int64)[: len(ids) + 1]
        got = np.frombuffer(data, "<u4")[edges[0] // 4 : edges[-1] // 4] if data is not None and edges[-1] else np.zeros(0, "<u4")
        return got, (edges[np.append(2 * first, len(ids))] - edges[0]) // 4

    def encode_column(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, edges): text k, a null being empty, has the ids from edges[k]
        to edges[k + 1], of which the last is ``end_id``.

        A text longer than a portion is cut at blanks, where no piece spans.
        """
        n = len(texts)
        texts = texts.cast(pa.large_string()).fill_null("")
        _, offsets, data = texts.buffers()
        edges = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        # runs of whole texts, and stretches of long ones, of about PORTION bytes each
        cuts, at = [int(edges[0])], int(edges[0])
        while at < edges[-1]:
            to = at + PORTION
            k = int(np.searchsorted(edges, to, side="right")) - 1
            if edges[k] > at:
                at = int(edges[k])
            else:
                stop = int(edges[k + 1])
                at = to
                while at < stop:
                    near = np.flatnonzero(_BLANK[raw[at : min(stop, at + (1 << 16))]])
                    if len(near):
                        at += int(near[0]) + 1
                        break
                    at = min(stop, at + (1 << 16))
                at = min(at, stop)
            cuts.append(at)
        parts, counts = [], np.zeros(n, np.int64)
        for lo, hi in zip(cuts, cuts[1:]):
            # the texts that have a stretch here
            i, j = int(np.searchsorted(edges, lo, side="right")) - 1, int(np.searchsorted(edges, hi, side="left"))
            inner = np.clip(edges[i : j + 1], lo, hi) - lo
            ids, where = self._encode(raw[lo:hi], inner[:-1], inner[1:])
            parts.append(ids)
            counts[i:j] += np.diff(where)
        out = np.empty(int(counts.sum()) + n, "<u4")
        bounds = np.concatenate([[0], np.cumsum(counts + 1)])
        own = np.ones(len(out), dtype=bool)
        own[bounds[1:] - 1] = False
        out[bounds[1:] - 1] = end_id
        out[own] = np.concatenate(parts) if parts else np.zeros(0, "<u4")
        return out, bounds


def encoder(path: str, keep: int | None = None) -> WordEncoder:
    """The worker's encoder of a vocabulary file; loaded once.  From now on it
    keeps at most ``keep`` words (``KEEP`` if not given)."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    _ENCODERS[path].keep = keep
    return _ENCODERS[path]


def portions(texts: pa.Array):
    """(from, to) of stretches of rows with about PORTION bytes of text each, or one longer text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    before, at = np.concatenate([[0], np.cumsum(sizes)]), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(before, before[at] + PORTION, side="right")) - 1)
        yield at, to
        at = to
