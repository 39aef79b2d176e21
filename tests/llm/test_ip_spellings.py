import pytest

from sensorloom.llm.surrogates import Surrogates, comparable


@pytest.mark.parametrize("one, other", [("10.0.0.1", "10.0.0.01"), ("192.168.1.10", "192.168.001.010"), ("172.16.0.9", "172.016.000.009"), ("85.1.2.3", "085.1.2.3")])
def test_both_spellings_of_an_address_are_one_entity(one, other):
    made = Surrogates(b"test")
    new, found = made.rewrite(f"From {one} to {other}, and {one}.")
    assert [e[3] for e in found] == [one] * 3
    plain, padded, again = (e[4] for e in found)
    assert plain == again and comparable("ip", padded) == plain != one
    assert new == f"From {plain} to {padded}, and {plain}."
    # The surrogate is padded where the address is, and one address has one surrogate in every text.
    assert all(len(p) >= len(o) for p, o in zip(padded.split("."), other.split(".")) if o[0] == "0")
    assert made.rewrite(other)[0] == padded
