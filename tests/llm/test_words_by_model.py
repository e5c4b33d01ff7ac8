"""Parts of letters alone go to the tokenizer's model; their ids are those of whole texts."""

import json
from array import array

import pytest

from panelwright.llm import tokens


class Spy:
    def __init__(self, tokenizer):
        self.tokenizer, self.seen = tokenizer, []

    def encode_batch_fast(self, parts, add_special_tokens):
        self.seen += parts
        return self.tokenizer.encode_batch_fast(parts, add_special_tokens=add_special_tokens)


def test_words_are_not_encoded_as_texts():
    encoder = tokens.Encoder(tokens.default_tokenizer())
    texts = ["The cat  sat.Über den Fluß, naïve Ærø Œuvre\nNew line's end 12ab", "\tTab ɏɏ ŉn ×a <|endoftext|> don't", "a", " a", "Antidisestablishmentarianism " * 9]
    whole = [array("I", x.ids).tobytes() for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    encoder.tokenizer = Spy(encoder.tokenizer)
    assert encoder.packed(texts) == whole
    assert encoder.tokenizer.seen and not [p for p in encoder.tokenizer.seen if p.isascii() and p.removeprefix(" ").isalpha()]


@pytest.mark.parametrize("change", [{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}])
def test_other_tokenizers_encode_every_part(tmp_path, change):
    with open(tokens.default_tokenizer(), encoding="utf-8") as file:
        told = json.load(file)
    path = tmp_path / "other.json"
    path.write_text(json.dumps(told | change), encoding="utf-8")
    assert not tokens.words_are_whole(str(path)) and tokens.words_are_whole(tokens.default_tokenizer())
