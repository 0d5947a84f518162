"""Ids put together from parts are the library's ids of whole texts."""

import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from folio.llm.queries import tokenizer_path
from folio.llm.token_ids import Encoder

PIECES = [
    *"abZéà×÷ßñ.,;:!?日-_|", " ", " ", " ", "  ", "\n", "\t", "\r\n", "\x00", "\x1c", "\x1f", "́", "\u0085", " ", " ", " ", " ", " ", "　", "​",
    "᠎", " ", "'s", "'", "1", "22", "<|endoftext|>", "<|", "|>", "the", "The", "word", "word.",
]


def whole(model, texts):
    return [[*e.ids, 2] for e in model.encode_batch(["" if t is None else t for t in texts], add_special_tokens=False)]


def test_parts_give_the_ids_of_whole_texts():
    rng = random.Random(5)
    texts = [None, "", " ", "  a  b ", "...", "a" * 5000 + " b", "x y. " * 3000]
    texts += ["".join(rng.choices(PIECES, k=rng.randint(1, 40))) for _ in range(20_000)]
    encoder, got = Encoder(tokenizer_path(), 2, most=3000), []  # so small that what is kept is given up again and again
    assert encoder.parted
    for i in range(0, len(texts), 500):
        got += [x.tolist() for x in encoder.encode(pa.array(texts[i : i + 500]))]
    assert got == whole(Tokenizer.from_file(tokenizer_path()), texts)


@pytest.mark.parametrize("before", [pre_tokenizers.Whitespace(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
def test_other_tokenizers_encode_whole_texts(tmp_path, before):
    model = Tokenizer(models.BPE(vocab={"a": 0, "b": 1, "Ġ": 2, "ab": 3, "Ġa": 4}, merges=[("a", "b"), ("Ġ", "a")]))
    model.pre_tokenizer = before
    model.save(str(tmp_path / "t.json"))
    encoder = Encoder(str(tmp_path / "t.json"), 2)
    assert not encoder.parted
    texts = ["ab a b", " a", "", None]
    assert [x.tolist() for x in encoder.encode(pa.array(texts))] == whole(model, texts)
