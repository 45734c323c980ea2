"""Encoding texts with a public tokenizer, each distinct word about once per worker.

The tokenizer drops white space and never forms a token across it, and its
normalisation never reaches across an ASCII white-space character. So the ids
of a text are the ids of its white-space separated chunks in a row, and a chunk
has to be encoded only when it is not remembered. For the same reason closing
punctuation may be cut off a chunk where the two meet at an ASCII letter or
digit; and A-Z may be put in lower case first, as the tokenizer does so itself,
unless a combining mark could join the letter or the text could name a special
token.

The memo is bounded. When it is full, the half that was learnt last goes: words
met early are the frequent ones.
"""

from __future__ import annotations

import os
from functools import cache
from itertools import islice

import numpy as np

END_ID = 1
MEMO_CHUNKS = 1_000_000
#: Bytes of the texts that are encoded at once, and words that are learnt in one text.
_AT_ONCE, _JOINED = 1 << 20, 4096


_SPACE, _WORD, _CLOSING = 1, 2, 3
_KINDS = np.zeros(256, np.uint8)
_KINDS[list(b" \t\n\v\f\r")] = _SPACE
_KINDS[[c for c in range(128) if chr(c).isalnum()]] = _WORD
_KINDS[list(b".,!?;:")] = _CLOSING


def chunks_of(texts: list[bytes], lower: bool) -> tuple[list[bytes], list[int]]:
    """The chunks of some texts in a row, closing punctuation as chunks of its own, and where each text's chunks end."""
    whole = b"\n".join([b"", *texts, b""])
    letters = np.frombuffer(whole, np.uint8)
    kind = _KINDS[letters]
    closing = kind == _CLOSING
    first = np.flatnonzero(closing & (np.roll(kind, 1) != _CLOSING))
    last = np.flatnonzero(closing & (np.roll(kind, -1) != _CLOSING))
    apart = first[(kind[first - 1] == _WORD) & (kind[last + 1] == _SPACE)]
    begins = np.flatnonzero((kind != _SPACE) & (np.roll(kind, 1) == _SPACE))
    ends = np.cumsum([len(text) + 1 for text in texts])
    counts = np.searchsorted(begins, ends) + np.searchsorted(apart, ends)
    if len(apart):
        whole = np.insert(letters, apart, ord(" ")).tobytes()
    return (whole.lower() if lower else whole).split(), counts.tolist()


def _plain(text: bytes) -> bool:
    """Whether A-Z may be put in lower case: no combining mark (by their first bytes) and no name of a special token."""
    return text.isascii() and b"<|" not in text or not (b"<|" in text or b"\xcc" in text or b"\xcd" in text)


class ChunkEncoder:
    """Token ids of texts as little-endian unsigned values, of 32 bits unless told otherwise, the end id included."""

    def __init__(self, path: str, end_id: int = END_ID, kind: str = "<u4", most: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.kind = kind
        self.most = MEMO_CHUNKS if most is None else most
        self.end = np.array([end_id], kind).tobytes()
        self.closes = _closing_tokens(self.library)
        self.memo: dict[bytes, bytes] = {b"": b""}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        done: list[bytes] = [b""] * len(texts)
        for plain in (True, False):
            mine = [i for i, text in enumerate(texts) if _plain(text) == plain]
            at = 0
            while at < len(mine):
                end, held = at + 1, len(texts[mine[at]])
                while end < len(mine) and held + len(texts[mine[end]]) <= _AT_ONCE:
                    held += len(texts[mine[end]])
                    end += 1
                for i, ids in zip(mine[at:end], self._encode([texts[i] for i in mine[at:end]], plain)):
                    done[i] = ids
                at = end
        return done

    def _encode(self, texts: list[bytes], lower: bool) -> list[bytes]:
        chunks, ends = chunks_of(texts, lower)
        found = list(map(self.memo.get, chunks))
        gaps = [i for i, ids in enumerate(found) if ids is None]
        if gaps:
            missing = dict.fromkeys(chunks[i] for i in gaps)
            if len(self.memo) + len(missing) > self.most:
                self.memo = dict(islice(self.memo.items(), self.most // 2))
            self._learn(missing)
            for i in gaps:
                found[i] = self.memo[chunks[i]]
        return [b"".join(found[a:b]) + self.end for a, b in zip([0, *ends], ends)]

    def _learn(self, chunks: dict[bytes, None]) -> None:
        words = [c for c in chunks if c.isalpha() or c.decode().isalpha()] if self.closes is not None else []
        for at in range(0, len(words), _JOINED):
            self.memo.update(zip(words[at:at + _JOINED], self._words(words[at:at + _JOINED])))
        rest = list(chunks.keys() - set(words))
        self.memo.update(zip(rest, self._each(rest)))

    def _each(self, parts: list[bytes]) -> list[bytes]:
        encoded = self.library.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in encoded]

    def _words(self, words: list[bytes]) -> list[bytes]:
        """The ids of words of letters, encoded in one text: a token that closes a word marks where each of them ends."""
        encoded, = self.library.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)
        ids = np.array(encoded.ids, self.kind)
        ends = (np.flatnonzero(self.closes[ids]) + 1).tolist()
        if len(ends) != len(words) or ends[-1] != len(ids):
            return self._each(words)
        size, whole = ids.itemsize, ids.tobytes()
        return [whole[a * size:b * size] for a, b in zip([0, *ends], ends)]


def _closing_tokens(library) -> np.ndarray | None:
    """Whether each id closes a word, for tokenizers that mark the last token of every word; none otherwise."""
    suffix = getattr(library.model, "end_of_word_suffix", None)
    if not suffix:
        return None
    vocabulary = library.get_vocab(with_added_tokens=True)
    closes = np.zeros(max(vocabulary.values()) + 1, bool)
    closes[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
    return closes


@cache
def encoder(path: str, end_id: int = END_ID, kind: str = "<u4", most: int | None = None) -> ChunkEncoder:
    """The encoder of this worker for one tokenizer file, with a memo of at most ``most`` chunks."""
    return ChunkEncoder(path, end_id, kind, most)


def narrowest(path: str, end_id: int = END_ID) -> str:
    """The narrowest type that holds every id of a tokenizer: 16 bits where they do, else 32."""
    from tokenizers import Tokenizer
    most = max(end_id, *Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values())
    return "<u2" if most < 1 << 16 else "<u4"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's file; it is the same on every worker."""
    import public_tokenizers
    return public_tokenizers.path(name)
