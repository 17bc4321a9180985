import inspect

import pytest

from treefuse.plans import bicluster, sparse
from treefuse.queries import QUERIES


class Called(Exception):
    pass


@pytest.mark.parametrize(("query", "module", "name"), [("sparse_path", sparse, "fit_sparse"), ("sparse_features", sparse, "fit_sparse"), ("bi_path", bicluster, "fit_bi"), ("bi_expand", bicluster, "fit_bi")])
def test_alternations_may_go_on_as_long_as_in_the_reference(spark, sf_dir, monkeypatch, query, module, name):
    fit = inspect.signature(getattr(module, name))

    def spy(*args, **kwargs):
        bound = fit.bind(*args, **kwargs)
        bound.apply_defaults()
        raise Called(bound.arguments["most"], bound.arguments["threshold"])

    monkeypatch.setattr(module, name, spy)
    with pytest.raises(Called) as found:
        QUERIES[query](spark, sf_dir)
    assert found.value.args == (500, 1e-5)
