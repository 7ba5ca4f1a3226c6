"""Token ids of whole texts with a `tokenizers` file, each distinct word encoded once.

BPE never merges across the borders its pre-tokenizer sets, so a text may be cut at such borders and the
parts encoded alone. Words are cut and numbered by Arrow, the library encodes those not met before, and
numpy puts the ids of a batch together. Texts in which a cut might not be such a border are encoded whole, and so
are texts that hold an added token such as <|endoftext|>: it gets its own id, as the library does by default.
"""

from __future__ import annotations

import os
import re
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Any character that some definition counts as white space, next to a blank.
BESIDE_BLANK = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}] | [\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
#: Words kept between batches; beyond that at most half of them stay, those met most often.
KEPT_WORDS = 300_000
#: Words put into one line for the tokenizer.
LINE = 1000
#: Characters given to the tokenizer in one call.
AT_ONCE = 1 << 18


class Encoder:
    """style "words": white space is dropped by the tokenizer, so any ASCII white space is a border.
    style "bytes": a single blank belongs to the word behind it; borders are such blanks."""

    def __init__(self, path: str, style: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.style = style
        vocabulary = self.tokenizer.get_vocab()
        #: Matches any added token, in any case: words are put in lower case before they are encoded.
        self.added = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values() if t.content)
        #: Ids that begin (style "bytes") or end (style "words") a word in a line of words.
        self.border = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, number in vocabulary.items():
            self.border[number] = token.startswith("Ġ") if style == "bytes" else token.endswith("</w>")
        # Entry 0 is the empty word; entries are numbered in the order in which their names came.
        self.known: dict[str, int] = {"": 0}
        self.flat, self.starts, self.sizes = np.empty(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.met = np.zeros(1, np.int64)

    def _forget(self) -> None:
        """Drops the words met once, and of the others those met less, until half the room is free."""
        least = 2 if (self.met > 1).sum() < KEPT_WORDS // 2 else int(np.partition(self.met, -(KEPT_WORDS // 2))[-(KEPT_WORDS // 2)]) + 1
        stays = self.met >= least
        stays[0] = True
        at = np.flatnonzero(stays)
        self.known = dict(zip(compress(self.known, stays.tolist()), range(len(at))))
        self.flat = gathered(self.flat, self.starts[at], self.sizes[at])
        self.sizes, self.met = self.sizes[at], self.met[at] // 2
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A few texts at a time: the library holds about a hundred bytes for each token of a call."""
        flat, sizes, at = [np.empty(0, np.uint32)], [np.empty(0, np.int64)], 0
        while at < len(texts):
            upto, held = at, 0
            while upto < len(texts) and held < AT_ONCE:
                held += len(texts[upto])
                upto += 1
            got = [e.ids for e in self.tokenizer.encode_batch_fast(texts[at:upto], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
            flat.append(np.fromiter(chain.from_iterable(got), np.uint32, int(sizes[-1].sum())))
            at = upto
        return np.concatenate(flat), np.concatenate(sizes)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many words in one line, taken apart again at the tokens that begin or end a word."""
        if self.style == "bytes":
            flat, sizes = self._encode([" " + " ".join(words[k : k + LINE]) for k in range(0, len(words), LINE)])
            at = np.flatnonzero(self.border[flat])
            if len(at) == len(words) and at[0] == 0:
                return flat, np.diff(np.append(at, len(flat)))
            return self._encode([" " + w for w in words])
        flat, sizes = self._encode([" ".join(words[k : k + LINE]) for k in range(0, len(words), LINE)])
        at = np.flatnonzero(self.border[flat]) + 1
        if len(at) == len(words) and at[-1] == len(flat):
            return flat, np.diff(np.concatenate(([0], at)))
        return self._encode(words)

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if w.isalpha()] if self.style == "words" else [w for w in words if "\n" not in w]
        taken = set(plain)
        rest = [w for w in words if w not in taken]
        for some, encode in ((plain, self._encode_words), (rest, self._encode)):
            if some:
                blank = " " if self.style == "bytes" and some is rest else ""
                flat, sizes = encode([blank + w for w in some] if blank else some)
                self.known.update(zip(some, range(len(self.sizes), len(self.sizes) + len(some))))
                self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))
                self.sizes = np.concatenate((self.sizes, sizes))
                self.flat = np.concatenate((self.flat, flat))
                self.met = np.concatenate((self.met, np.zeros(len(some), np.int64)))

    def _table(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and number of ids of each word; a full stop or comma behind a letter is a token of its own."""
        if self.style == "words":
            words = pc.if_else(pc.string_is_ascii(words), pc.ascii_lower(words), words)
        split = pc.match_substring_regex(words, "[A-Za-zß-ö][.,]$")
        stems = pc.if_else(split, pc.utf8_slice_codeunits(words, 0, -1), words)
        marks = pc.if_else(split, pc.utf8_slice_codeunits(words, -1), "").dictionary_encode()
        stems = stems.dictionary_encode()
        names = stems.dictionary.to_pylist()
        if len(self.known) > KEPT_WORDS:
            self._forget()
        known = self.known
        of_name = np.fromiter(map(known.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(of_name < 0)
        words = [names[k] for k in new]
        self._learn(words)
        of_name[new] = [known[w] for w in words]
        self.met[of_name] += 1
        signs = [m for m in marks.dictionary.to_pylist() if m]
        bare = dict(zip(signs, self._bare(signs)))
        of_stem = of_name[stems.indices.to_numpy()]
        of_mark = np.array([bare.get(m, 0) for m in marks.dictionary.to_pylist()], np.int64)[marks.indices.to_numpy()]
        entries = np.stack((of_stem, of_mark), axis=1).ravel()
        sizes = self.sizes[entries]
        return gathered(self.flat, self.starts[entries], sizes), sizes.reshape(-1, 2).sum(axis=1)

    def _bare(self, signs: list[str]) -> list[int]:
        """Entries of marks without a blank before them."""
        names = ["\0" + m for m in signs]
        for name, sign in zip(names, signs):
            if name not in self.known:
                flat, sizes = self._encode([sign])
                self.known[name] = len(self.sizes)
                self.starts = np.append(self.starts, len(self.flat))
                self.sizes = np.append(self.sizes, sizes)
                self.flat = np.append(self.flat, flat)
                self.met = np.append(self.met, 1)
        return [self.known[n] for n in names]

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and where each text's ids start (one more than texts)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        if not n:
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        whole = np.zeros(n, bool)
        if self.added:
            whole |= pc.match_substring_regex(texts, self.added, ignore_case=True).to_numpy(zero_copy_only=False)
        if self.style == "words":
            pieces = pc.ascii_split_whitespace(pc.if_else(pa.array(whole), "", texts))
        else:
            whole |= pc.match_substring_regex(texts, BESIDE_BLANK).to_numpy(zero_copy_only=False)
            pieces = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
        bounds = pieces.offsets.to_numpy().astype(np.int64)
        coded = pieces.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds = bounds - bounds[0]
        index = coded.indices.to_numpy().astype(np.int64)
        if self.style == "words":
            flat, sizes = self._table(coded.dictionary)
            at = np.flatnonzero(whole)
            if len(at):
                own_flat, own_sizes = self._encode(texts.take(pa.array(at)).to_pylist())
                index[bounds[at]] = len(sizes) + np.arange(len(at))
                flat, sizes = np.concatenate((flat, own_flat)), np.concatenate((sizes, own_sizes))
        else:
            # A text's first piece has no blank before it. An empty later piece is a blank at the text's end.
            heads = coded.dictionary.take(pa.array(index[bounds[:-1]])).to_pylist()
            at = np.flatnonzero(whole)
            for i, text in zip(at, texts.take(pa.array(at)).to_pylist()):
                heads[i] = text
            empty = coded.dictionary.index("").as_py()
            flat, sizes = self._table(coded.dictionary)
            own_flat, own_sizes = self._encode([*heads, " "])
            index[bounds[:-1]] = len(sizes) + np.arange(n)
            if empty >= 0:
                index[index == empty] = len(sizes) + n
            flat, sizes = np.concatenate((flat, own_flat)), np.concatenate((sizes, own_sizes))
        counts = sizes[index]
        ends = np.concatenate(([0], np.cumsum(counts)))
        return gathered(flat, (np.cumsum(sizes) - sizes)[index], counts), ends[bounds]


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of each, one after another."""
    if not len(starts):
        return flat[:0]
    steps = np.ones(int(sizes.sum()), np.int64)
    full = sizes > 0
    starts, sizes = starts[full], sizes[full]
    if not len(starts):
        return flat[:0]
    steps[0] = starts[0]
    steps[np.cumsum(sizes)[:-1]] = starts[1:] - starts[:-1] - sizes[:-1] + 1
    return flat[np.cumsum(steps, out=steps)]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, style: str) -> Encoder:
    """One per Python worker."""
    if (path, style) not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        _encoders[path, style] = Encoder(path, style)
    return _encoders[path, style]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def blocks(batches, text: str = "text", most_bytes: int = 4 << 20):
    """Record batches in runs of about so many bytes of text, never cutting a row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // most_bytes
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(a, b - a)
