"""Token ids of whole texts with a public tokenizer file, in Arrow batches inside the tasks.

Texts are cut where a byte-level tokenizer never merges: before white space that follows other characters, and after letters that ASCII marks or
digits follow. So the ids of the parts, put together, are the ids of the text, and a bounded memo of parts saves most of the work,
since words repeat. A part of letters alone is one pre-token of a byte-level tokenizer: it goes to the tokenizer's model at once, without the
encoding (offsets, masks, type ids) that a text gets. Tests compare with whole-text encoding.
"""

from __future__ import annotations

import json
import os
import re
from array import array

# The characters that Unicode calls white space; Latin letters; ASCII marks and digits but the apostrophe.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LETTERS = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
MARKS = r"!-&(-@\[-`{-~"
PARTS = re.compile(rf"[{WHITE}]*(?:[{LETTERS}]+(?=[{WHITE}{MARKS}]|\Z)|[^{WHITE}]+)|[{WHITE}]+")
WORD = re.compile(rf" ?[{LETTERS}]+")

#: The character that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on.
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: 0x100 + i for i, b in enumerate(sorted(set(range(256)) - set(PRINTED)))}
SPACE = chr(BYTE_CHARS[0x20])

MEMO_PARTS = 400_000
MEMO_CHARS = 80
GROUP_CHARS = 1_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def words_are_whole(path: str) -> bool:
    """Whether the file is a plain byte-level BPE that cuts texts by the usual expression, and letters alone are no added token."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    cut = told.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    added = any(re.search(rf"^[ {LETTERS}]+$", x["content"]) for x in told.get("added_tokens", []))
    return bool(plain and told["model"].get("type") == "BPE" and not told.get("normalizer") and not told.get("truncation") and not added)


class Encoder:
    """Ids of texts as packed little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.of_word = self.tokenizer.model.tokenize if words_are_whole(path) else None
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, parts: set[str]) -> None:
        """Every part into the memo: from the older half, or words by the model and others encoded in one call."""
        memo, older, of_word, new = self.memo, self.older, self.of_word, []
        for p in parts:
            if p not in memo:
                known = older.get(p)
                if known is not None:
                    memo[p] = known
                elif of_word and WORD.fullmatch(p):
                    shown = p.replace(" ", SPACE) if p.isascii() else p.encode().decode("latin-1").translate(BYTE_CHARS)
                    memo[p] = array("I", [x.id for x in of_word(shown)]).tobytes()
                else:
                    new.append(p)
        for p, found in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            ids = array("I", found.ids)
            memo[p] = ids.tobytes()

    def packed(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            size, start = 0, at
            while at < len(texts) and (at == start or size + len(texts[at]) <= GROUP_CHARS):
                size += len(texts[at])
                at += 1
            parts = [PARTS.findall(t) for t in texts[start:at]]
            every = set().union(*parts)
            self._learn(every)
            memo = self.memo
            out += [b"".join(map(memo.__getitem__, p)) for p in parts]
            for p in every:
                if len(p) > MEMO_CHARS:
                    del memo[p]
            if len(memo) > MEMO_PARTS:
                self.older, self.memo = memo, {}
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file, so that its memo outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
