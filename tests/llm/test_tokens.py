import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from breakwater.llm.tokens import Encoder

ENCODERS = {n: Encoder(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}
PARTS = ["a", "Bc", "é", "́", " ", "  ", "\n", "\t", "\x1c", "　", "\xa0", "1", "'s", "!", "ß", "İ", "🙂", "日", "<|endoftext|>", "<|"]


@pytest.mark.parametrize("name", ENCODERS)
def test_ids_equal_those_of_whole_texts(name):
    e = ENCODERS[name]

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), max_size=6))
    def check(texts):
        assert [x.tolist() for x in e.ids(texts)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]

    check()
