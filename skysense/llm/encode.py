"""Token ids of many texts at once.

The vocabulary of ``word_bpe_49k.json`` never joins characters across white space, nor
letters with punctuation or digits: those are borders of its pre-tokens, and white space
is dropped. So a text's ids are the ids of its chunks between ASCII white space, one
after another, and equal chunks of many texts are encoded once. Plain chunks (lower-case
Latin letters, digits, punctuation) are cut into pre-tokens and merged by tiktoken, with
the file's own vocabulary as ranks; all others go to the tokenizers library as they are.
Tests hold the ids against that library on whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Letters that normalisation leaves alone, and ASCII punctuation without the apostrophe
# (contractions are pre-tokens of their own).
_LETTERS = "a-zß-öø-ÿ"
_PUNCTUATION = r"!-&(-/:-@\[-`{-~"
_WORD = f"^[{_LETTERS}]+$"
_PLAIN = f"^[{_LETTERS}0-9{_PUNCTUATION}]+$"
_PART = f"([{_LETTERS}]+|[0-9]|[{_PUNCTUATION}]+)"
# Added tokens, which are found before anything else, begin so.
_ADDED = "<|"


def chunks_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of texts without nulls: row of each chunk, its number among the different chunks, and these."""
    texts = texts.cast(pa.large_string())
    if not pc.any(pc.match_substring(texts, _ADDED)).as_py():
        # The tokenizer lowers letters anyway; here it makes chunks equal. Copied first,
        # because ascii_lower reads the offsets of a slice wrongly.
        texts = pc.ascii_lower(texts.take(pa.array(np.arange(len(texts)))))
    lists = pc.ascii_split_whitespace(texts)
    rows = pc.list_parent_indices(lists).to_numpy()
    coded = pc.list_flatten(lists).dictionary_encode()
    return rows, coded.indices.to_numpy(), coded.dictionary


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary, reversed."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class WordEncoder:
    """Encodes with a byte-level tokenizers file that marks the ends of words."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = self.tokenizer.model.end_of_word_suffix
        if not suffix:
            raise ValueError(f"{path} doesn't mark the ends of words")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        vocabulary = {p: i for p, i in vocabulary.items() if not p.startswith(_ADDED) or p.endswith(suffix)}
        alphabet = byte_alphabet()
        # A space, which no pre-token holds, stands for the end of a word.
        ranks = {bytes(alphabet[c] for c in p.removesuffix(suffix)) + b" " * p.endswith(suffix): i
                 for p, i in vocabulary.items()}
        self.merges = tiktoken.Encoding("words", pat_str=r"[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for p, i in vocabulary.items() if p.endswith(suffix)]] = True

    def _plain(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain chunks, and the number of ids of each."""
        if not len(chunks):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        empty, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
        words = pc.match_substring_regex(chunks, _WORD)
        parts = pc.if_else(words, pc.binary_join_element_wise(chunks, empty, space),
                           pc.replace_substring_regex(chunks, _PART, r"\1 "))
        counts = pc.count_substring(parts, " ").to_numpy().astype(np.int64)
        joined = "".join(parts.to_numpy(zero_copy_only=False))
        ids = np.array(self.merges.encode_ordinary(joined), dtype="<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        last = stops[np.cumsum(counts) - 1]
        return ids, np.diff(last, prepend=0)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` (no nulls), and the number of ids of each text."""
        rows, number, different = chunks_of(texts)
        plain = pc.and_not(pc.match_substring_regex(different, _PLAIN), pc.match_substring(different, _ADDED))
        plain = plain.to_numpy(zero_copy_only=False).astype(bool)
        sizes = np.zeros(len(different), np.int64)
        ids, sizes[plain] = self._plain(different.filter(pa.array(plain)))
        rest = [e.ids for e in self.tokenizer.encode_batch_fast(
            different.filter(pa.array(~plain)).to_pylist(), add_special_tokens=False)]
        sizes[~plain] = [len(x) for x in rest]
        flat = np.concatenate([ids, *[np.array(x, dtype="<u4") for x in rest if x]])
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        starts = np.zeros(len(different), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        each = sizes[number]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        if not total:
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        at = np.arange(total, dtype=np.int64) + np.repeat(starts[number] - (ends - each), each)
        return flat[at], np.bincount(rows, weights=each, minlength=len(texts)).astype(np.int64)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for the file at ``path``."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
