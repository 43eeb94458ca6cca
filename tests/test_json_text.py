import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from factweave.functions import json_text

VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(), x, max_size=4), max_leaves=20)


@given(VALUES, st.booleans())
def test_the_stacked_parser_reads_what_json_reads(v, spaced):
    text = json.dumps(v, indent=2 if spaced else None)
    assert json_text._stacked(text) == json.loads(text)


@pytest.mark.parametrize("text", ["", " ", "[", "[1,", "[1,]", "{", '{"a"', '{"a":', '{"a":1,', '{"a":1,}', "{1:2}", "[1 2]", "1 2", "]", "tru", '"a', "01", "[}", "{]"])
def test_what_is_no_json(text):
    with pytest.raises(ValueError):
        json_text._stacked(text)
    with pytest.raises(ValueError):
        json_text.loads(text)


def test_any_depth_and_any_number():
    text = '{"a":[' * 50_000 + "1" + "]}" * 50_000
    assert json_text.dumps(json_text.loads(text), tight=True) == text
    assert json_text.loads("[" + "9" * 5_000 + "]") == [float("inf")]
