"""BPE encoding and decoding of whole texts by prefix-sharing trie traversal."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trackspark.llm.common import give_back, hold, small_batches, tidy

#: Distinct words whose encodings a task keeps between batches.
KEEP_WORDS = 100_000
#: Pairs of tokens of which a task keeps whether one may follow the other.
KEEP_PAIRS = 200_000
#: Rows of one Arrow batch, so that a batch of long texts fits in memory.
BATCH_ROWS = 256

# Characters up to U+017F that Unicode's normal forms and every notion of white
# space agree on, and the letters and numerals among them.
_PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e\\xa1-\\u017f]*")
_L = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u017f"
_N = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
_PLAIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^ \\t\\n\\r{_L}{_N}]+")
#: The rules of a file that _PLAIN_WORDS follows.
_KNOWN_RULES = (
    '[{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\\\s+"}, "content": " "}, {"type": "Lowercase"}]',
    "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
)


class WordEncoder:
    """Encodes words with the merges of a tokenizers file, many at a time.

    Of a word's prefix only the last token of its encoding matters. A token t
    that ends a prefix is that last token exactly if t may follow the last
    token of the prefix before it: if the two tokens, merged as one text, come
    apart into the same two tokens. Distinct words in sorted order are a trie
    read depth first: the states (last tokens) of the prefix that a word shares
    with the word before stay on the stack, and only the rest is worked out.
    A word's encoding is read from its states from the end to the start.
    """

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        #: Whether plain texts may be cut into words here, without the library.
        self.plain = (
            json.dumps((spec["normalizer"] or {}).get("normalizers")),
            spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"],
        ) == _KNOWN_RULES
        #: The file without its vocabulary.
        self.rules = spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None}
        self.end: str = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.text = {i: s for s, i in self.vocab.items()}
        self.special: dict[str, int] = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.text |= {i: s for s, i in self.special.items()}
        # The leftmost special token, and of several the longest; none if there is none.
        longest = sorted(self.special, key=len, reverse=True)
        self.specials = re.compile(f"({'|'.join(map(re.escape, longest)) or '(?!)'})")
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: By pair of tokens: rank and merged token.
        self.merges = {
            (self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b])
            for rank, (a, b) in enumerate(merges)
        }
        #: By token: the two tokens that it is made of, if any.
        self.parts = {made: pair for pair, (_, made) in reversed(self.merges.items())}
        #: Tokens whose own text is encoded as that one token; no other is ever used.
        self.usable = {t: i for t, i in self.vocab.items() if i not in self.parts or self._apart(*self.parts[i], made=True)}
        #: The beginnings of all tokens' own texts; a reader's state is the longest one that its text ends with.
        self.starts = {own[:k] for own in map(self._own, self.usable) for k in range(1, len(own) + 1)}
        #: By state: its text, the state after each symbol met so far, and, within a word and
        #: at its end, the merged tokens that its text ends with (length, token; longest first).
        self.states: dict[str, int] = {"": 0}
        self.reads, self.after = [""], [{}]
        self.chains: tuple[list[tuple], list[tuple]] = ([()], [()])
        #: By pair of tokens, as one number: whether the second may follow the first.
        self.fits: dict[int, bool] = {}

    def _own(self, token: str) -> str:
        return token.removesuffix(self.end)

    def _step(self, state: int, symbol: str) -> int:
        """The state after a symbol that a state has not met yet."""
        text = self.reads[state] + symbol
        while text and text not in self.starts:
            text = text[1:]
        found = self.states.get(text)
        if found is None:
            found = self.states[text] = len(self.reads)
            self.reads.append(text)
            self.after.append({})
            for chain, suffix in zip(self.chains, ("", self.end)):
                tokens = [(len(text) - k, self.usable.get(text[k:] + suffix)) for k in range(len(text) - 1)]
                chain.append(tuple((n, t) for n, t in tokens if t in self.parts))
        self.after[state][symbol] = found
        return found

    def _apart(self, left: int, right: int, made: bool = False) -> bool:
        """Whether the two tokens side by side stay the two tokens that they are.

        With ``made``: whether they come about side by side, to be merged then.
        """
        # Undo the merges of both sides from the latest on. A merge across the
        # border that comes before the one undone last would have won. Of equal
        # merges the leftmost comes first: the border's is to the left of the
        # right side's (and wins a tie) and to the right of the left side's.
        bound = len(self.merges)
        while True:
            across = self.merges.get((left, right))
            if across is not None and across[0] < bound and not made:
                return False
            made = False
            left_rank = self.merges[self.parts[left]][0] if left in self.parts else -1
            right_rank = self.merges[self.parts[right]][0] if right in self.parts else -1
            if left_rank < 0 and right_rank < 0:
                return True
            if left_rank > right_rank:
                bound, left = left_rank, self.parts[left][1]
            else:
                bound, right = right_rank + 1, self.parts[right][0]

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """The token ids of each distinct word, of byte-level symbols."""
        found: dict[str, list[int]] = {}
        if len(self.fits) > KEEP_PAIRS:
            self.fits.clear()
        fits, after, vocab, end = self.fits, self.after, self.vocab, self.end
        within, at_end = self.chains
        last: list[int] = [-1]  # by length of the prefix: last token of its encoding
        width: list[int] = [0]  # how many symbols that token has
        state: list[int] = [0]  # and what the reader has seen
        before = ""
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            # All states but the word's last are those of an unfinished word.
            del last[shared + 1 :], width[shared + 1 :], state[shared + 1 :]
            n, now = len(word), state[-1]
            for at in range(len(last), n + 1):
                symbol = word[at - 1]
                new = after[now].get(symbol)
                now = self._step(now, symbol) if new is None else new
                for size, token in (within if at < n else at_end)[now]:
                    if size == at:
                        break
                    pair = last[at - size] << 32 | token
                    fit = fits.get(pair)
                    if fit is None:
                        fit = fits[pair] = self._apart(last[at - size], token)
                    if fit:
                        break
                else:
                    size, token = 1, vocab[symbol if at < n else symbol + end]
                if at < n:
                    last.append(token)
                    width.append(size)
                    state.append(now)
            ids = [token]
            at = n - size
            while at > 0:
                ids.append(last[at])
                at -= width[at]
            ids.reverse()
            found[word] = ids
            before = word
        return found


class Known:
    """Words of a task and what they are encoded as, KEEP_WORDS at most.

    When it is full, the words that came again in a later batch stay.
    """

    def __init__(self) -> None:
        self.words: dict[str, tuple[bytes, str]] = {}
        self.again: set[str] = set()

    def missing(self, met: set[str]) -> set[str]:
        """Which of a batch's words are to be encoded and put in."""
        new = met - self.words.keys()
        self.again |= met - new
        if len(self.words) + len(new) > KEEP_WORDS:
            stay = self.again if len(self.again) + len(new) <= KEEP_WORDS else met - new
            self.words = {w: self.words[w] for w in stay}
            self.again = set()
        return new

    def clear(self) -> None:
        self.words, self.again = {}, set()


@lru_cache(maxsize=2)
def _tools(path: str) -> tuple[Tokenizer, WordEncoder, Known]:
    """The library with a file's rules (it cuts texts, and needs no vocabulary), the encoder, and its words."""
    hold("bpe", _tools.cache_clear)
    encoder = WordEncoder(path)
    give_back()  # what reading the file took
    return Tokenizer.from_str(json.dumps(encoder.rules)), encoder, Known()


def _words(text: str, tokenizer: Tokenizer, encoder: WordEncoder) -> list[str]:
    """The words of a text, special tokens among them, by the file's rules.

    Words of plain characters are as they stand in the text; others come from
    the library, in byte-level symbols, marked by a leading NUL.
    """
    found: list[str] = []
    # With one group in the pattern, every other part is a special token.
    for k, part in enumerate(encoder.specials.split(text)):
        if k % 2:
            found.append(part)
        elif encoder.plain and _PLAIN.fullmatch(part):
            found += _PLAIN_WORDS.findall(part.lower())
        elif part:
            cut = tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(part))
            found += ["\0" + w for w, _ in cut]
    return found


def encode_batch(texts: list[str], path: str) -> tuple[list[bytes], list[str]]:
    """Ids and decoded text of each text of a batch."""
    tokenizer, encoder, kept = _tools(path)
    words = [_words(text, tokenizer, encoder) for text in texts]
    new = kept.missing(set().union(*words))
    known = kept.words
    special = new & encoder.special.keys()
    for s in special:
        known[s] = (struct.pack("<I", encoder.special[s]), s)
    symbols: dict[str, list[str]] = {}
    for w in new - special:
        own = w[1:] if w[0] == "\0" else w if w.isascii() else _byte_level(w)
        symbols.setdefault(own, []).append(w)
    for own, ids in encoder.encode_words(symbols).items():
        both = struct.pack(f"<{len(ids)}I", *ids), " ".join([encoder.text[i] for i in ids])
        for w in symbols[own]:
            known[w] = both
    ids, decoded = [], []
    for own in words:
        pairs = [known[w] for w in own]
        ids.append(b"".join([p[0] for p in pairs]))
        decoded.append(" ".join([p[1] for p in pairs]))
    return ids, decoded


@lru_cache(maxsize=1)
def _byte_symbols() -> dict[int, str]:
    """The symbol of each byte: itself if it prints in Latin-1, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _byte_level(word: str) -> str:
    return word.encode().decode("latin-1").translate(_byte_symbols())


def forget(path: str) -> None:
    """Let go of the words that a task has met: its worker may serve other stages next."""
    _, encoder, known = _tools(path)
    known.clear()
    encoder.fits.clear()


def bpe(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids (binary), decoded.

    ``path`` is a tokenizers file, present on every worker, of a BPE model over
    byte-level symbols with a word-end suffix and no decoder of its own. Texts
    are normalised and cut into words by that file's own rules, special tokens
    in a text included; distinct words of a batch that the worker has not met
    yet are encoded together through :class:`WordEncoder`. ``ids`` are
    little-endian unsigned 32-bit integers, ``decoded`` is their text.

    Rows are mapped one to one, in Arrow batches of a few hundred rows, without
    a shuffle; a task keeps a bounded number of known words. A null text is
    an empty one, with no tokens; long texts are encoded whole; repeated rows,
    null ids and other columns do no harm; an empty table gives an empty result.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(start, BATCH_ROWS)
                ids, decoded = encode_batch(batch.column(1).to_pylist(), path)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                        pa.array(decoded, pa.string()),
                    ],
                    names=["id", "n_tokens", "ids", "decoded"],
                )
        forget(path)

    small_batches(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        tidy(encode, "bpe"), f"id {kind}, n_tokens long, ids binary, decoded string"
    ).withColumnRenamed("id", id_col)
