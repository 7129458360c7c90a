import pytest
from marginalia.llm import pii


@pytest.mark.parametrize("text", ["john.doe (At) example (Dot) com", "a{aT}b.org", "10[DOT]20[DOT]30[DOT]40", "10(Dot)20(dOt)30[dot]40", "x [AT] y.com", "1[.]2(.)3[.]4", "no forms here"])
def test_hints_lose_no_wide_form(text):
    assert pii.wide_spans(text) == [(kind, *m.span()) for kind, pattern in pii.WIDE.items() for m in pattern.finditer(text)]
