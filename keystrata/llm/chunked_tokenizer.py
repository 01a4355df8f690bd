"""The tokenizers library behind a cache of text chunks. Ids are those of its plain call.

Both vocabularies split a text at white space before any merge, so the ids of a text are those of
its chunks in order. A chunk is encoded by the library once while it stays in the cache.
Where the rules of a vocabulary that drops white space are the known ones, chunks are also cut
between letters and punctuation, A-Z are lowered first, and new chunks of small letters alone, on
which the other rules do nothing, go to the library's model without these rules.

A column of texts is cut into chunks on its own buffer: numpy finds the borders, Arrow's dictionary
encoding finds the distinct chunks, only these are looked up, and ids are gathered by place.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array

import numpy as np

#: Chunks of a byte-level vocabulary: a run without blanks with one leading space, or blanks.
KEEPS_BLANKS = "keeps"
#: Chunks of a vocabulary that drops white space: a run without blanks.
DROPS_BLANKS = "drops"
#: Put between chunks that are encoded together, where one of these is a single id.
MARKS = ("^", "~", "`", "=")
TOGETHER = 64
#: Rules of a vocabulary that lowers letters and ends each run of letters where it meets something else.
_LOWERS = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITS = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Words that these rules leave as they are, as one piece each.
_PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch


class _Cache:
    """Number of each chunk, and its ids in one growing array."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 14, np.int64)
        self.used = 0

    def add(self, chunks: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.number)
        self.ids = _with_room(self.ids, self.used + len(ids))
        self.ends = _with_room(self.ends, n + len(chunks))
        self.ids[self.used : self.used + len(ids)] = ids
        self.ends[n : n + len(chunks)] = self.used + np.cumsum(sizes)
        self.used += len(ids)
        self.number.update(zip(chunks, range(n, n + len(chunks)), strict=True))

    def get(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of numbered chunks, one after another, and how many each has."""
        begins = np.where(numbers > 0, self.ends[numbers - 1], 0)
        sizes = self.ends[numbers] - begins
        return _gather(self.ids, begins, sizes), sizes


def _with_room(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


def _gather(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of `values`, one after another."""
    shift = begins - (np.cumsum(sizes) - sizes)
    return values[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))]


#: White space of the Unicode property: one byte here, more in _blanks; fixed values.
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[9, 10, 11, 12, 13, 32]] = True
_CACHES: dict[tuple[str, str], _Cache] = {}
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _blanks(raw: np.ndarray) -> np.ndarray:
    """Which bytes are white space, that of two and three bytes included."""
    blank = _IS_BLANK[raw]
    lead = np.flatnonzero((raw == 0xC2) | ((raw >= 0xE1) & (raw <= 0xE3)))
    lead = lead[lead < len(raw) - 1]
    a, b, c = raw[lead], raw[lead + 1], raw[np.minimum(lead + 2, len(raw) - 1)]
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    three = (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    three |= (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    far = lead[two | three]
    blank[far] = blank[far + 1] = True
    blank[lead[three] + 2] = True
    return blank


def _rules(part) -> dict | None:
    return json.loads(part.__getstate__()) if part is not None else None


@functools.lru_cache(4)
def kept_tokenizer(path: str, chunks: str, cache_size: int, at_once: int) -> ChunkedTokenizer:
    """A tokenizer that the worker process loads once for all its tasks."""
    return ChunkedTokenizer(path, chunks, cache_size, at_once)


class ChunkedTokenizer:
    """The cache belongs to the worker process and serves its next tasks too; full, it takes no more.

    `at_once` is how many bytes of text are cut at once. Both bound the memory that a worker keeps.
    """

    def __init__(self, path: str, chunks: str, cache_size: int = 1_500_000, at_once: int = 4_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        #: Strings that the vocabulary takes as one id wherever they stand; a text that holds one is encoded whole.
        self.special = [t.content.lower() for t in self.model.get_added_tokens_decoder().values()]
        self.cache = _CACHES.setdefault((path, chunks), _Cache())
        self.cache_size, self.at_once = cache_size, at_once
        self.spaced = chunks == KEEPS_BLANKS
        self.fine = not self.spaced and _rules(self.model.normalizer) == _LOWERS and _rules(self.model.pre_tokenizer) == _SPLITS
        self.bare = self._without_rules() if self.fine else None
        self.many = getattr(self.model, "encode_batch_fast", self.model.encode_batch)
        self.mark = next((m for m in MARKS if len(self._ids(" " + m if self.spaced else m)) == 1), None)
        self.mark_id = self._ids(" " + self.mark if self.spaced else self.mark)[0] if self.mark else None

    def _without_rules(self):
        """The model behind white space alone; None if its ids do not tell where words end."""
        from tokenizers import Tokenizer, pre_tokenizers

        suffix = getattr(self.model.model, "end_of_word_suffix", None)
        if not suffix:
            return None
        vocab = self.model.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        bare = Tokenizer(self.model.model)
        bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return getattr(bare, "encode_batch_fast", bare.encode_batch)

    def _ids(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def _encode_new(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of new chunks in the order they were encoded in, their ids one after another, and how many each has.

        Most are encoded together, apart by a mark; those that may hold it or join with it alone.
        """
        texts = b" ".join(chunks).decode("utf-8").split(" ") if self.fine and chunks else [c.decode("utf-8") for c in chunks]
        alone, joint, order, found, sizes = [], [], [], [], []
        rest = range(len(texts))
        if self.bare:
            plain, rest = [], []
            for i, c in enumerate(texts):
                (plain if _PLAIN(c) else rest).append(i)
            for lo in range(0, len(plain), 32_768):
                part = plain[lo : lo + 32_768]
                made = self.bare([" ".join([texts[i] for i in part[k : k + TOGETHER]]) for k in range(0, len(part), TOGETHER)], add_special_tokens=False)
                ids = np.frombuffer(b"".join([array("I", e.ids) for e in made]), np.uint32)
                last = np.flatnonzero(self.ends_word[ids])
                if len(last) != len(part) or last[-1] != len(ids) - 1:
                    rest += part
                    continue
                order += part
                sizes.append(np.diff(last, prepend=-1))
                found.append(ids)
        for i in rest:
            c = texts[i]
            plain = self.mark and self.mark not in c and (c[0] == " " and len(c) > 1 if self.spaced else True)
            (joint if plain else alone).append(i)
        glue = f" {self.mark}" if self.spaced else f" {self.mark} "
        for lo in range(0, len(joint), 32_768):
            parts = [joint[i : i + TOGETHER] for i in range(lo, min(lo + 32_768, len(joint)), TOGETHER)]
            good = []
            for part, e in zip(parts, self.many([glue.join([texts[i] for i in p]) for p in parts], add_special_tokens=False), strict=True):
                ids = array("I", e.ids)
                ids.append(self.mark_id)
                if ids.count(self.mark_id) == len(part):
                    order += part
                    good.append(ids)
                else:  # a chunk of its own yields the mark's id
                    alone += part
            ids = np.frombuffer(b"".join(good), np.uint32)
            marks = ids == self.mark_id
            sizes.append(np.diff(np.flatnonzero(marks), prepend=-1) - 1)
            found.append(ids[~marks])
        for lo in range(0, len(alone), 16_384):
            part = alone[lo : lo + 16_384]
            one = [array("I", e.ids) for e in self.many([texts[i] for i in part], add_special_tokens=False)]
            order += part
            sizes.append(np.fromiter(map(len, one), np.int64, len(one)))
            found.append(np.frombuffer(b"".join(one), np.uint32))
        if not order:
            return np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.array(order, np.int64), np.concatenate(found), np.concatenate(sizes)

    def _fine_chunks(self, raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes without blanks and A-Z, where chunks begin in these, and where they did in `raw`.

        A piece ends between a letter and an ASCII character that is none, and between an ASCII character
        that is neither letter nor apostrophe and a letter; nothing joins an ASCII character to what is
        before it. A capital letter that a combining mark may follow stays.
        """
        blank = _blanks(raw)
        letter = _IS_LETTER[raw]
        other = raw < 128
        other &= ~letter
        apart = other & (raw != 39)
        start = np.empty(len(raw), bool)
        start[1:] = apart[:-1] & letter[1:] | blank[:-1]
        lead = np.flatnonzero(raw[:-1] == 0xC3)  # letters of Latin-1, without the signs of multiplication and division
        letter[lead + 1] = (raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)
        start[1:] |= letter[:-1] & other[1:]
        start[begins] = True
        start &= ~blank
        low = raw.copy()
        capital = np.flatnonzero(raw - 65 < 26)
        low[capital[raw[np.minimum(capital + 1, len(raw) - 1)] < 0xCA]] |= 32
        full = ~blank
        return low[full], np.flatnonzero(start[full]), np.flatnonzero(start)

    def _borders(self, raw: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where chunks begin. A vocabulary that drops blanks gets each word with those behind it."""
        blank = _blanks(raw)
        first = np.zeros(len(raw), bool)
        first[begins] = True
        after_blank = np.concatenate(([False], blank[:-1])) & ~first
        if not self.spaced:
            return np.flatnonzero(first | (after_blank & ~blank))
        # A run of blanks is a chunk without its last one, if a word follows; that one is a chunk, or opens the word's if it is a space.
        after_space = np.concatenate(([False], raw[:-1] == 32)) & ~first
        start = first | (after_blank & ~blank & ~after_space) | (blank & ~after_blank)
        last = np.flatnonzero(blank[:-1] & ~blank[1:] & ~first[1:])
        for _ in range(2):  # back to the first byte of the character
            last -= (raw[last] & 0xC0) == 0x80
        start[last] = True
        return np.flatnonzero(start)

    def encode_with_end(self, texts, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of an Arrow string array without nulls, an end after each text, and the place behind each end."""
        ids, sizes = self.encode_column(texts)
        ends = np.cumsum(sizes + 1)
        out = np.full(len(ids) + len(sizes), end_id, np.uint32)
        inside = np.ones(len(out), bool)
        inside[ends - 1] = False
        out[inside] = ids
        return out, ends

    def encode_column(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of an Arrow string array without nulls, one text after another, and how many each text has."""
        import pyarrow as pa
        import pyarrow.compute as pc

        whole = self._whole_texts(texts, pc)
        if not whole:
            return self._chunked_column(texts)
        mask = np.zeros(len(texts), bool)
        mask[whole] = True
        ids, sizes = self._chunked_column(pc.if_else(pa.array(mask), "", texts))
        own = [np.array(self._ids(texts[i].as_py()), np.uint32) for i in whole]
        at = np.cumsum(sizes)[whole]
        sizes[whole] = [len(o) for o in own]
        return np.insert(ids, np.repeat(at, sizes[whole]), np.concatenate(own)), sizes

    def _whole_texts(self, texts, pc) -> list[int]:
        """Places of texts that hold a special string, in any case."""
        start = os.path.commonprefix(self.special)[:2] if self.special else ""
        if not start:
            return []
        may = np.flatnonzero(pc.match_substring(texts, start).to_numpy(zero_copy_only=False)) if len(texts) else []
        return [int(i) for i in may if any(s in (t := texts[int(i)].as_py().lower()) for s in self.special)]

    def _chunked_column(self, texts) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        data = texts.buffers()[2] if len(texts) else None
        whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        ids, sizes, lo = [], [], 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + self.at_once, "right")) - 1)
            got = self._encode_slice(whole[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            ids.append(got[0])
            sizes.append(got[1])
            lo = hi
        return (np.concatenate(ids), np.concatenate(sizes)) if ids else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _encode_slice(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow as pa

        n = len(offsets) - 1
        begins = offsets[:-1][np.diff(offsets) > 0]
        if len(raw) and self.fine:
            raw, at, was = self._fine_chunks(raw, begins)
        elif len(raw):
            at = was = self._borders(raw, begins)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        chunks = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, len(raw)).astype(np.int32)), pa.py_buffer(raw)]).dictionary_encode()
        distinct = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(self.cache.number.get, distinct, [-1] * len(distinct)), np.int64, len(distinct))
        fresh, known = np.flatnonzero(number < 0), np.flatnonzero(number >= 0)
        old_ids, old_sizes = self.cache.get(number[known]) if len(known) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        order, new_ids, new_sizes = self._encode_new([distinct[i] for i in fresh.tolist()])
        fresh = fresh[order]
        new = [distinct[i] for i in fresh.tolist()]
        if len(self.cache.number) < self.cache_size and new:
            self.cache.add(new, new_ids, new_sizes)
        size, begin = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        size[known], size[fresh] = old_sizes, new_sizes
        begin[known] = np.cumsum(old_sizes) - old_sizes
        begin[fresh] = len(old_ids) + np.cumsum(new_sizes) - new_sizes
        which = chunks.indices.to_numpy()
        each = size[which]
        ids = _gather(np.concatenate((old_ids, new_ids)), begin[which], each)
        before = np.concatenate(([0], np.cumsum(each)))
        return ids, np.diff(before[np.searchsorted(was, offsets)])

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        import pyarrow as pa

        ids, sizes = self.encode_column(pa.array(texts, pa.string()))
        raw, ends = ids.tobytes(), np.cumsum(sizes)
        return [raw[4 * a : 4 * b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
