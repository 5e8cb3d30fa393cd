"""Token ids of whole texts by a tokenizer file whose pre-tokenizer drops white space.

A word between ASCII white space is encoded once and kept, since nothing the tokenizer does crosses white space:
its normaliser works on single characters and on combining marks, which never join a space, and its pattern leaves
white space out of every piece. The memory of kept words is bounded; beyond it the words are encoded anew.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEPT_WORDS = 400_000
#: What a tokenizer file must say for its texts to be encoded word by word; another file's texts are encoded whole.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}
#: Signs that are a piece of their own where they follow or, but for the apostrophe, precede a letter or digit.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
FRONT = SIGNS.replace("'", "")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def plain_strings(texts: pa.Array) -> pa.Array:
    """Strings with 32-bit offsets: pyarrow's ascii functions misread slices of arrays with 64-bit ones."""
    return texts if texts.type == pa.string() else pa.array(texts.to_pylist(), pa.string())


class WordIds:
    """Encodes texts by way of their words; a word's ids are kept as bytes of little-endian unsigned 32-bit integers.

    What was used since half of the words came in is kept when the memory is full. ASCII signs around a word that begins or ends
    with a letter or digit are pieces of their own, since the pattern parts them, and ASCII capitals count as small letters, since
    the normaliser makes them so; neither needs a word's ids anew. New words of letters alone are one piece each, so many are
    encoded at once, and a piece's last id, which stands for an end of word, parts them.
    """

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.kept = Tokenizer.from_file(path), kept
        vocabulary, rules = self.tokenizer.get_vocab(), json.loads(self.tokenizer.to_str())
        self.by_words = all(rules[k] == v for k, v in RULES.items()) and rules["model"].get("end_of_word_suffix") == "</w>" and all("<|" in t["content"] for t in rules["added_tokens"])
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.new: dict[bytes, bytes] = {b"": b""}
        self.old: dict[bytes, bytes] = {}

    def plain(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of words, in small ASCII letters and without special tokens, that aren't among the new; they are from now on."""
        old, new, found, parted = self.old, self.new, {}, []
        bare: set[str] = set()
        for word in words:
            ids = old.get(word)
            if ids is not None:
                found[word] = ids
                continue
            t = word.decode("utf-8", "replace")
            if t.isalpha():
                bare.add(t)
                parted.append((word, "", t, ""))
                continue
            base = t.rstrip(SIGNS)
            after = t[len(base) :]
            core = base.lstrip(FRONT)
            before = base[: len(base) - len(core)]
            if core and (core[-1].isalnum() or not after) and (core[0].isalnum() or not before):
                parted.append((word, before, core, after))
                bare.update((before, core, after))
            else:
                parted.append((word, "", t, ""))
                bare.add(t)
        known = {"": b""}
        letters = []
        for t in bare:
            ids = new.get(w := t.encode()) or old.get(w)
            if ids is not None:
                known[t] = ids
            elif len(t) <= 64 and t.isalpha() and t.lower().isalpha():
                letters.append(t)
            elif t:
                known[t] = self.plain(w)
        if letters:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(letters) and ends[-1] == len(ids):
                flat, ends = ids.tobytes(), (ends * 4).tolist()
                known.update(zip(letters, map(flat.__getitem__, map(slice, [0, *ends[:-1]], ends))))
            else:
                known.update((t, self.plain(t.encode())) for t in letters)
        for word, before, core, after in parted:
            found[word] = known[before] + known[core] + known[after]
        new.update(found if max(map(len, found)) <= 64 else {w: ids for w, ids in found.items() if len(w) <= 64})
        return found

    def encode_many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: of an empty one), one after another, and where each text's ids begin and end."""
        texts = pc.fill_null(plain_strings(texts), "")
        if not self.by_words:
            parts = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, "<u4"), *parts]), np.r_[0, np.cumsum([len(p) for p in parts], dtype=np.int64)]
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        if special.any():  # such texts may hold special tokens, which are found before anything else
            parts = [np.array(self.tokenizer.encode(t.as_py(), add_special_tokens=False).ids, "<u4") if s else self.encode_many(texts.slice(k, 1))[0] for k, (t, s) in enumerate(zip(texts, special))]
            return np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        words = lists.flatten().cast(pa.binary()).dictionary_encode()
        kinds = words.dictionary.to_pylist()
        got = list(map(self.new.get, kinds))
        if None in got:
            holes = [i for i, x in enumerate(got) if x is None]
            found = self.learn([kinds[i] for i in holes])
            for i in holes:
                got[i] = found[kinds[i]]
            if len(self.new) >= self.kept // 2:
                self.old, self.new = self.new, {b"": b""}
        ends = np.cumsum(np.fromiter(map(len, got), np.int64, len(got)) // 4)
        ragged = pa.LargeListArray.from_arrays(pa.array(np.r_[0, ends]), pa.array(np.frombuffer(b"".join(got), "<u4")))
        taken = ragged.take(words.indices)
        at = np.asarray(taken.offsets)
        at = at - at[0]
        bounds = np.asarray(lists.offsets)
        return np.asarray(taken.flatten()), at[bounds - bounds[0]]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_many(pa.array([text], pa.string()))[0].tolist()


_KNOWN: dict[tuple[str, int], WordIds] = {}


def word_ids(path: str, kept: int = KEPT_WORDS) -> WordIds:
    """One for each file in a process: a Python worker runs many tasks, and its words serve all of them."""
    if (path, kept) not in _KNOWN:
        _KNOWN[path, kept] = WordIds(path, kept)
    return _KNOWN[path, kept]
