"""Token ids of whole texts by the tokenizers library, with each word encoded once.

The tokenizers used here cut at white space before anything else, and their
normalisation doesn't reach across ASCII white space, so a text's ids are those
of its blank-separated chunks in order.  A chunk of letters with punctuation
after them is two units of the tokenizer, any other is one here.  Arrow cuts
the chunks of many texts into units and puts the units' ids together; Python
sees each different unit once, and keeps its ids while the worker lives, up to
a fixed number.
"""

from __future__ import annotations

import functools
import gc
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 2
#: Units a worker remembers in each of two generations.  When the young one is
#: full it becomes the old one, and what is used again moves to the new one.
MOST_KEPT = 300_000
#: Bytes of text to hand over at once; units repeat, so more at once cost less.
AT_A_TIME = 4 << 20
#: Words encoded by one call.
AT_ONCE = 16_384
_TAIL = ".,!?;:*#$%&|\"()"
#: The letters below U+0100; each is lower-cased by itself.
_LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha())
_WORD = f"^[{_LETTERS}]+$"
_EMPTY = pa.scalar(b"", pa.large_binary())


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Encodes with the tokenizer in the file ``path``, which must lower-case and
    split at white space (checked), without special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = json.dumps([spec["normalizer"], spec["pre_tokenizer"]])
        if '"Lowercase"' not in steps or r"\\s\\p{L}" not in steps or spec["pre_tokenizer"]["pretokenizers"][-1]["type"] != "ByteLevel":
            raise ValueError("the tokenizer doesn't lower-case words split at white space")
        # words of lower-case letters need no more than the cut at blanks and the byte alphabet
        plain = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, spec["pre_tokenizer"]["pretokenizers"][-1]]}
        self.lean = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": plain}))
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        size = max(vocab.values()) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.ends = np.zeros(size, dtype=bool)
        for token, i in vocab.items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        self.units: dict[bytes, bytes] = {}  # by a unit's UTF-8
        self.old_units: dict[bytes, bytes] = {}

    def _raw(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in found]

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Units of lower-case letters alone, encoded in one go and cut where the tokenizer ends a word."""
        found = self.lean.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0]
        ids = np.array(found.ids, dtype=self.dtype)
        stops = ((np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize).tolist()
        if len(stops) != len(words):
            return self._raw(words)
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def _look_up(self, units: pa.Array) -> pa.Array:
        """The ids of different units, as bytes."""
        names = units.cast(pa.binary()).to_pylist()
        found = list(map(self.units.get, names))
        gaps = [i for i, ids in enumerate(found) if ids is None]
        if gaps:
            plain = pc.match_substring_regex(units.take(pa.array(gaps, pa.int64())), _WORD).to_pylist()
            words, whole = [], []
            for i, word in zip(gaps, plain, strict=True):
                if (ids := self.old_units.get(names[i])) is not None:
                    found[i] = ids
                else:
                    (words if word else whole).append(i)
            for encode, new in ((self._words, words), (self._raw, whole)):
                for at in range(0, len(new), AT_ONCE):
                    some = new[at : at + AT_ONCE]
                    for i, ids in zip(some, encode([names[i] for i in some]), strict=True):
                        found[i] = ids
            self.units.update((names[i], found[i]) for i in gaps)
        return pa.array(found, pa.large_binary())

    def encode(self, texts: list[str] | pa.Array, end: int | None = END_ID) -> list[np.ndarray]:
        """The ids of each whole text, and ``end`` after them; a null text is empty."""
        collects = gc.isenabled()
        gc.disable()  # no cycles arise here, but millions of objects to look through
        try:
            return self._encode(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), end)
        finally:
            if collects:
                gc.enable()

    def forget(self) -> None:
        """Drops the old generation, as the worker may idle beside other work from here on."""
        self.old_units = {}

    def _encode(self, texts: pa.Array, end: int | None) -> list[np.ndarray]:
        if len(self.units) > MOST_KEPT:
            self.old_units, self.units = self.units, {}
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        chunks = coded.dictionary
        word = pc.ascii_rtrim(chunks, characters=_TAIL)
        plain = pc.match_substring_regex(word, _WORD)
        unit = pc.if_else(plain, pc.utf8_lower(word), chunks).dictionary_encode()
        tail = pc.if_else(plain, pc.utf8_ltrim(chunks, characters=_LETTERS), "").dictionary_encode()
        found = pc.binary_join_element_wise(*(self._look_up(x.dictionary).take(x.indices) for x in (unit, tail)), _EMPTY)
        # all ids in a row: Arrow puts each chunk's bytes one after another
        taken = found.take(coded.indices)
        stops = np.frombuffer(taken.buffers()[1], dtype=np.int64)[: len(taken) + 1] if len(taken) else np.zeros(1, dtype=np.int64)
        ids = np.frombuffer(taken.buffers()[2] or b"", dtype=self.dtype, count=int(stops[-1]) // self.dtype.itemsize)
        cuts = stops[np.asarray(split.offsets) - split.offsets[0].as_py()] // self.dtype.itemsize
        if end is not None:
            cuts = cuts + np.arange(len(cuts))
            whole = np.full(len(ids) + len(texts), end, dtype=self.dtype)
            inner = np.ones(len(whole), dtype=bool)
            inner[cuts[1:] - 1] = False
            whole[inner] = ids
            ids = whole
        cuts = cuts.tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process."""
    return Encoder(path)
