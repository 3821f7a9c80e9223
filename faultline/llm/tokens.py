"""Token ids of whole texts, by the ``tokenizers`` library, one library call per many distinct units.

Both vocabularies split a text into words before they merge bytes, so the ids of a text are the ids
of its pieces, if it is cut only where the splitting pattern cannot match across:

* ``word``: white space is dropped, so any blank or line feed is a cut;
* ``byte``: a blank belongs to the word after it. A cut is right before a single blank, and on both
  sides of a single line feed, if neither has white space around it. Texts in which that does not
  hold are cut only before single blanks between other characters.

Distinct pieces are cut further into units, between a Latin letter and an ASCII digit or mark other than the
apostrophe, where both patterns always split. Cutting, finding distinct pieces and putting ids together
are Arrow and numpy kernels over many texts. Units that are one run of letters, met for the first
time, go to the library as one text, whose word numbers tell their ids apart; other units go one by
one. The library finds added tokens (``<|endoftext|>``) in the raw text before it splits, across any
cut, so a text that holds one goes to it whole. A worker keeps the units' ids, as packed bytes, in two tables of bounded
size: a full one becomes the older, and units still in use move on from it, so only those unused for a whole table are
learned again.
"""

from __future__ import annotations

import functools
import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Distinct units after which a worker begins a new table; it remembers the one before.
CACHE_UNITS = 200_000
_ODD = r"[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]| {2}| \n|\n |\n\n|\A[ \n]|[ \n]\z"
_L, _P = "[A-Za-zÀ-ÖØ-öø-ÿ]", r"[!-&(-@\[-`{-~]"
_LETTERS = re.compile(f" ?{_L}+")
_JOIN = 1000


def _gather(values, sizes, index):
    """The runs of ``values`` (of these sizes, one after another) that ``index`` names, and where each ends."""
    import numpy as np

    n = sizes[index]
    ends = np.cumsum(n)
    if not len(n):
        return values[:0], ends
    shift = (np.cumsum(sizes) - sizes)[index] - (ends - n)
    kind = np.int32 if max(ends[-1], len(values)) < 1 << 31 else np.int64
    at = np.repeat(shift.astype(kind), n)
    at += np.arange(ends[-1], dtype=kind)
    return values[at], ends


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, kind: str, end_id: int | None = None):
        from tokenizers import Tokenizer

        if kind not in ("word", "byte"):
            raise ValueError(kind)
        self.lib = Tokenizer.from_file(path)
        added = self.lib.get_added_tokens_decoder().values()
        if any(x.normalized for x in added):
            raise ValueError("added tokens that are found after normalisation")
        self.added = [x.content for x in added]
        self.kind = kind
        self.end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        self.units: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _one_by_one(self, units: list[str]) -> None:
        import numpy as np

        for a in range(0, len(units), _JOIN):
            part = units[a : a + _JOIN]
            for unit, got in zip(part, self.lib.encode_batch_fast(part, add_special_tokens=False)):
                self.units[unit] = np.asarray(got.ids, "<u4").tobytes()

    def _together(self, units: list[str], between: str) -> None:
        """Units that are one word each to the library; ``between`` is one more word, or none if blank or empty."""
        import numpy as np

        step = 2 if between == "\n" else 1
        for a in range(0, len(units), _JOIN):
            part = units[a : a + _JOIN]
            got = self.lib.encode(between.join(part), add_special_tokens=False)
            counts = np.bincount(np.asarray(got.word_ids, np.int64))
            if len(counts) != step * (len(part) - 1) + 1:
                self._one_by_one(part)
                continue
            ends = (np.cumsum(counts) * 4)[::step]
            starts = ends - counts[::step] * 4
            raw = np.asarray(got.ids, "<u4").tobytes()
            self.units.update(zip(part, map(raw.__getitem__, map(slice, starts.tolist(), ends.tolist()))))

    def _learn(self, units: list[str]) -> None:
        letters = list(filter(_LETTERS.fullmatch, units))
        if len(letters) < len(units):
            self._one_by_one(list(set(units).difference(letters)))
        if self.kind == "word":
            self._together(letters, " ")
        else:
            self._together([u for u in letters if u[0] == " "], "")
            self._together([u for u in letters if u[0] != " "], "\n")

    @staticmethod
    def _odd_pieces(text: str) -> list[str]:
        """Cut only before a single blank that stands between two characters that aren't white space."""
        return re.split(r"(?<=[^\s\x1c-\x1f])(?= [^\s\x1c-\x1f])", text)

    def _cut(self, texts):
        """Each text's pieces, as an Arrow list array; None for texts that hold the separator."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if self.kind == "word":
            return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        odd = pc.match_substring_regex(texts, _ODD)
        marked = pc.replace_substring(pc.replace_substring(texts, "\n", "\0\n\0"), " ", "\0 ")
        if pc.any(odd).as_py():
            slow = ["\0".join(self._odd_pieces(t)) if o else None for t, o in zip(texts.to_pylist(), odd.to_pylist())]
            marked = pc.if_else(odd, pa.array(slow, texts.type), marked)
        return pc.split_pattern(marked, "\0")

    def _apart(self, texts):
        """Texts that only the library can take whole, with the separator or the content of an added token; None if there are none."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        _, offsets, data = texts.buffers()
        if data is None:
            return None
        ends = np.frombuffer(offsets, "<i8" if pa.types.is_large_string(texts.type) else "<i4")[[texts.offset, texts.offset + len(texts)]]
        raw = bytes(memoryview(data)[ends[0] : ends[1]])  # one search over all texts is cheap, a search in each is not
        found = [pc.match_substring(texts, x) for x in ("\0", *self.added) if x.encode() in raw]
        return functools.reduce(pc.or_, found) if found else None

    def encode(self, texts) -> list[bytes]:
        """``texts``: an Arrow string array or a list; nulls are empty texts."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        texts = pc.fill_null(texts, "")
        whole, apart = {}, self._apart(texts)
        if apart is not None:
            whole = {k: self._whole(texts[k].as_py()) for k in np.flatnonzero(apart.to_numpy(zero_copy_only=False)).tolist()}
            texts = pc.if_else(apart, "", texts)
        cut = self._cut(texts)
        bounds = cut.offsets.to_numpy()
        pieces = pc.dictionary_encode(cut.flatten())
        values, sizes = self._pieces(pieces.dictionary)
        ids, ends = _gather(values, sizes, pieces.indices.to_numpy())
        raw = ids.tobytes()
        at = (np.concatenate([[0], ends])[bounds - bounds[0]] * 4).tolist()
        out = [raw[a:b] + self.end for a, b in zip(at, at[1:])]
        for k, ids in whole.items():
            out[k] = ids
        return out

    def _pieces(self, pieces):
        """Ids of distinct pieces, one after another, and how many each has."""
        import numpy as np
        import pyarrow.compute as pc

        if self.kind == "word":
            pieces = pc.if_else(pc.match_substring_regex(pieces, r"[^\x00-\x{ff}]"), pieces, pc.utf8_lower(pieces))
        for a, b in ((_L, _P), (_P, _L)):
            pieces = pc.replace_substring_regex(pieces, f"({a})({b})", "\\1\0\\2")
        cut = pc.split_pattern(pieces, "\0")
        bounds = cut.offsets.to_numpy()
        units = pc.dictionary_encode(cut.flatten())
        names = units.dictionary.to_pylist()
        if len(self.units) > CACHE_UNITS:
            self.older, self.units = self.units, {}
        got = list(map(self.units.get, names))
        if None in got:
            missing = [k for k, x in enumerate(got) if x is None]
            new = []
            for k in missing:
                ids = self.older.get(names[k])
                if ids is None:
                    new.append(names[k])
                else:
                    self.units[names[k]] = ids
            self._learn(new)
            for k in missing:
                got[k] = self.units[names[k]]
        sizes = np.fromiter(map(len, got), np.int64, len(got)) >> 2
        ids, ends = _gather(np.frombuffer(b"".join(got), "<u4"), sizes, units.indices.to_numpy())
        return ids, np.diff(np.concatenate([[0], ends])[bounds - bounds[0]])

    def _whole(self, text: str) -> bytes:
        import numpy as np

        return np.asarray(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + self.end


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, kind: str, end_id: int | None) -> Encoder:
    """The worker's encoder; it outlives a task, and so do the pieces it knows."""
    key = (path, kind, end_id)
    if key not in _encoders:
        _encoders[key] = Encoder(path, kind, end_id)
    return _encoders[key]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def array_groups(texts, limit: int = 3_000_000):
    """Index ranges of an Arrow string array, of at most ``limit`` bytes (or one text)."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    yield from ((a, b) for a, b in zip(cuts, cuts[1:]) if b > a)


def groups_of(texts: list, limit: int = 4_000_000):
    """Index ranges of at most ``limit`` characters (or one text), to bound a worker's memory."""
    a = n = 0
    for i, t in enumerate(texts):
        size = len(t or "")
        if n and n + size > limit:
            yield a, i
            a, n = i, 0
        n += size
    if a < len(texts):
        yield a, len(texts)
