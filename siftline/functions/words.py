"""The words of texts in Arrow batches: bytes are classed and cut as arrays, nothing is called for each text or word."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut at a time (one text at least).
SLICE = 1 << 20


def splitter(stopwords: tuple[str, ...], counts: bool = False, added: tuple[tuple[tuple[str, ...], tuple[str, ...]], ...] = ()) -> Callable[[pa.Array], pa.Array]:
    """A function from texts to the list of each one's words; ``counts``: to its number of words and the distinct ones with how often they stand.

    ``added``: phrases (without letters of two cases) and distinct words; a text in which one of the phrases stands gets those of the words that it lacks, behind its own.
    Runs of [A-Za-z0-9_], lower-cased, and of Han characters (U+4E00 to U+9FFF, three bytes each) are words, but for stop words; a Han run
    over two characters gives its bigrams that are no stop words, and then itself up to six. Null gives null.
    The function stands alone, since workers need not have this module.
    """
    step = SLICE
    singles, pairs = [w for w in stopwords if len(w) == 1], [w for w in stopwords if len(w) == 2]
    longer = [w.encode() for w in stopwords if len(w) > 2]

    def tables() -> tuple[np.ndarray, ...]:
        word, low = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
        word[[c for c in range(128) if chr(c).isalnum() or chr(c) == "_"]] = 1
        low[65:91] += 32
        one = np.zeros(1 << 16, bool)
        one[[ord(w) for w in singles]] = True
        # A pair is looked up by the numbers of its first and of its second character among those of the stop words.
        at, codes = [np.zeros(1 << 16, np.uint8) for _ in range(2)], [sorted({ord(w[i]) for w in pairs}) for i in range(2)]
        for i in range(2):
            at[i][codes[i]] = np.arange(1, len(codes[i]) + 1)
        two = np.zeros((len(codes[0]) + 1, len(codes[1]) + 1), bool)
        for w in pairs:
            two[at[0][ord(w[0])], at[1][ord(w[1])]] = True
        return word, low, one, at[0], at[1], two

    held: list[tuple[np.ndarray, ...]] = []  # filled by the worker

    def strings(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
        ends = np.zeros(len(lengths) + 1, np.int32)
        np.cumsum(lengths, out=ends[1:])
        return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))

    def cut(b: np.ndarray, rows: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The words of bytes b, and how many each text has; rows are the starts of the texts, and the end."""
        word, low, one, first_at, second_at, two = held[0]
        number = np.int32 if len(b) < 1 << 27 else np.int64
        kind = word[b]
        lead = np.zeros(len(b), bool)
        if len(b) > 2:
            lead[:-2] = ((b[:-2] > 0xE4) & (b[:-2] < 0xEA)) | ((b[:-2] == 0xE4) & (b[1:-1] >= 0xB8))
        is_han = bool(lead.any())
        if is_han:
            for i in range(3):
                kind[i:][lead[: len(b) - i]] = 2
        edge = np.ones(len(b) + 1, bool)
        edge[1:-1] = kind[1:] != kind[:-1]
        edge[rows] = True
        bounds = np.flatnonzero(edge).astype(number)
        start, length = bounds[:-1], np.diff(bounds)
        of_run = kind[start]
        kept = of_run > 0
        start, length, of_run = start[kept], length[kept], of_run[kept]
        if not is_han:
            return strings(low[b[kind > 0]], length), np.diff(np.searchsorted(start, rows))
        code = np.zeros(len(b), np.uint16)
        at = np.flatnonzero(lead)
        code[at] = ((b[at].astype(np.uint16) & 15) << 12) | ((b[at + 1].astype(np.uint16) & 63) << 6) | (b[at + 2] & 63)
        n = np.where(of_run == 2, length // 3, 0)

        def stopped(s: np.ndarray) -> np.ndarray:
            return two[first_at[code[s]], second_at[code[s + 3]]]

        gone = np.zeros(len(start), bool)
        gone[n == 1] = one[code[start[n == 1]]]
        gone[n == 2] = stopped(start[n == 2])
        for w in longer:
            like = np.flatnonzero((n > 2) & (length == len(w)))
            gone[like[(b[start[like, None] + np.arange(len(w))] == np.frombuffer(w, np.uint8)).all(axis=1)]] = True
        start, length, n = start[~gone], length[~gone], n[~gone]
        times = np.where(n < 3, 1, np.where(n < 7, n, n - 1))
        before = np.cumsum(times) - times
        j = (np.arange(times.sum()) - np.repeat(before, times)).astype(number)
        start, length, n = (np.repeat(x, times) for x in (start, length, n))
        paired = (n > 2) & (j < n - 1)
        start, length = np.where(paired, start + 3 * j, start), np.where(paired, 6, length)
        open_ = ~paired
        open_[paired] = ~stopped(start[paired])
        start, length = start[open_], length[open_]
        # Where each word's bytes begin: in the text, less where they begin in the result.
        moved = (start - (np.cumsum(length) - length)).astype(np.int64)
        data = low[b[np.repeat(moved, length) + np.arange(length.sum())]]
        text = np.searchsorted(rows, start, "right") - 1
        return strings(data, length), np.bincount(text, minlength=len(rows) - 1)

    def extended(values: pa.Array, sizes: np.ndarray, rows: np.ndarray, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of texts and how many each has, with those of words that a text of rows lacks behind its own."""
        ends = np.cumsum(sizes)
        lacks = np.ones((len(sizes), len(words)), bool)
        if len(values):
            starts, data = np.frombuffer(values.buffers()[1], np.int32)[: len(values)], np.frombuffer(values.buffers()[2], np.uint8)
            at = np.flatnonzero(np.isin(data[starts], [w.as_py().encode()[0] for w in words]))  # few words begin with these bytes
            code = pc.fill_null(pc.index_in(values.take(pa.array(at)), value_set=words), -1).to_numpy()
            lacks[np.searchsorted(ends, at[code >= 0], "right"), code[code >= 0]] = False
        row, word = np.nonzero(lacks[rows])
        order = np.insert(np.arange(len(values)), ends[rows[row]], len(values) + word)
        return pa.concat_arrays([values, words]).take(pa.array(order)), sizes + np.bincount(rows[row], minlength=len(sizes))

    def lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
        ends = np.zeros(len(sizes) + 1, np.int32)
        np.cumsum(sizes, out=ends[1:])
        return pa.ListArray.from_arrays(pa.array(ends), values)

    def counted(values: pa.Array, sizes: np.ndarray) -> pa.Array:
        coded = values.dictionary_encode()
        k = max(len(coded.dictionary), 1)
        pair, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * k + coded.indices.to_numpy(), return_counts=True)
        text, code = np.divmod(pair, k)
        words = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(code)), pa.array(tf.astype(np.int64))], ["token", "tf"])
        return pa.StructArray.from_arrays([pa.array(sizes.astype(np.int32)), lists(words, np.bincount(text, minlength=len(sizes)))], ["len", "words"])

    def split(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(tables())
        none = texts.is_null()
        texts = texts.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
        named = []  # the texts in which phrases stand, and the words for them
        for phrases, new in added:
            stands = [pc.match_substring(texts, phrase).to_numpy(zero_copy_only=False) for phrase in phrases]
            named.append((np.flatnonzero(np.any(stands, axis=0)), pa.array(new, pa.string())))
        done, parts = 0, []
        while done < len(texts) or not parts:
            to = min(max(int(np.searchsorted(offsets, offsets[done] + step, "right")) - 1, done + 1), len(texts))
            found = cut(data[offsets[done] : offsets[to]], offsets[done : to + 1] - offsets[done])
            for at, new in named:
                if len(rows := at[np.searchsorted(at, done) : np.searchsorted(at, to)] - done):
                    found = extended(*found, rows, new)
            parts.append(counted(*found) if counts else lists(*found))
            done = to
        out = pa.concat_arrays(parts)
        return out if not none.true_count else pc.if_else(none, pa.scalar(None, out.type), out)

    return split
