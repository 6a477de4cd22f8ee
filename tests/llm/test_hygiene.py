"""What reaches the driver is listed with its bound; no localCheckpoint, cross join or local folder."""

import pathlib
import re

import flightperf.llm

LLM = pathlib.Path(flightperf.llm.__file__).parent
ALLOWED = {     # file: calls whose result is bounded (ranges, classes, parameters, samples)
    "digests.py": 1, "decontam.py": 1, "neural_lm.py": 4, "quality.py": 1, "toxicity.py": 1,
}


def test_driver_side_results_are_the_listed_ones():
    for p in LLM.glob("*.py"):
        n = len(re.findall(r"\.collect\(\)", p.read_text()))
        assert n <= ALLOWED.get(p.name, 0), p.name


def test_forbidden():
    for p in LLM.glob("*.py"):
        text = p.read_text()
        for pat in (r"localCheckpoint", r"crossJoin", r"\bmkdtemp\b", r"\btempfile\b", r"\.toPandas\(\)", r"except ImportError"):
            assert not re.search(pat, text), (p.name, pat)


def test_nothing_else_imports_the_subpackage():
    for p in LLM.parent.rglob("*.py"):
        if LLM not in p.parents:
            assert "flightperf.llm" not in p.read_text(), p
