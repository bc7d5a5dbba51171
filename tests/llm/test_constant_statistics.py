"""Statistics that never varied in training have no say in scores."""

from __future__ import annotations

from llm.conftest import prose

from tidemark.llm import factorisation


def test_a_constant_statistic_counts_as_0():
    machine = factorisation.train([prose(i, 60 + i) for i in range(40)], [i % 2 for i in range(40)])
    at, x = next(machine.rows([prose(99, 6000)]))
    own = dict(zip(factorisation.STATISTICS, x[-len(factorisation.STATISTICS) :], strict=True))
    assert own["long"] == 0 and own["log_words"] > 0
