"""Long texts of one pattern, which make careless patterns take hours: every step stays about linear."""

import signal
from collections import Counter

import pytest

from docweft.llm import bpe, personal, quality, residue, scans, variants

UNITS = ("a", "1", " ", "\t", "\n", "a,", "| ", ". ", "- a\n", "x   y ", "Home > ", "deadbeef12 ", "Aa ", "a@", "a.", "省市区街道", "1 2 3 ", "(", "[", "{{", "%A", "_", "A. B. ", "ab-\n", "+1 ", "Mr ", "The x is y. ", "a; ", "=-")


@pytest.fixture
def limit():
    def stop(*_):
        raise TimeoutError

    before = signal.signal(signal.SIGALRM, stop)
    signal.alarm(20)
    yield
    signal.alarm(0)
    signal.signal(signal.SIGALRM, before)


@pytest.mark.parametrize("unit", UNITS)
def test_linear(limit, unit):
    text = unit * (120_000 // len(unit))
    quality.Counter(["the", "的"])(text, text[:400], text[:400])
    assert personal.maybe_personal(text) or not personal.spans(text)
    personal.cell_spans([[text, text]])
    scans._grams(text, 1, Counter(), Counter())
    scans.features(scans.lines_of(text), 1, set())
    residue.STATUS.search(text), residue.REPEATED.search(text), residue.BARE.search(text)
    variants.read(text[:5000], False, set())
    codec = bpe.codec(bpe.default_vocabulary())
    assert codec.decode(codec.encode(text)) == text
