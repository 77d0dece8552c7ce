"""Model classes for loading snapshots, and algorithms by name."""

from __future__ import annotations

import inspect
import json

from affinis.models import als, boosted, gradient, latent, means, neighbours, spectral, tagged
from affinis.models.base import FactorModel, ZeroModel
from affinis.sources.tables import read_text

KINDS = {c.__name__: c for c in (
    FactorModel, ZeroModel, spectral.NeighbourSVDModel, tagged.LassoModel, tagged.SwitchModel,
    neighbours.KNNModel, neighbours.RaterKNNModel)}

# name -> (fit function, default arguments). Tag-based ones also take item_tags, n_tags.
ALGORITHMS: dict[str, tuple] = {}


def register(name: str, fit, **defaults) -> None:
    """Add an algorithm: ``fit(ratings, ...)`` returning an object with ``predict``."""
    ALGORITHMS[name] = (fit, defaults)


for _name, _fit in {
    "zero": means.fit_zero, "als": als.fit_als, "als2": als.fit_als_biased, "als3": als.fit_als3, "xals": als.fit_xals,
    "wals": als.fit_wals, "als_mllib": als.fit_als_mllib, "balse": tagged.fit_balse, "svd": spectral.fit_svd,
    "svd1": spectral.fit_svd1, "svd2": spectral.fit_svd2, "svdknn": spectral.fit_svdknn, "ssvd": gradient.fit_ssvd,
    "knn": neighbours.fit_knn, "knn2": neighbours.fit_knn2, "knn0": neighbours.fit_knn2, "sgd": gradient.fit_sgd,
    "sgd0": gradient.fit_sgd0, "sgd2": gradient.fit_sgd2, "lasso": tagged.fit_lasso, "gbr": boosted.fit_gbr,
    "pca": spectral.fit_pca, "nmf": latent.fit_nmf, "efa": latent.fit_efa, "cfm": als.fit_cfm, "fma": tagged.fit_fma,
}.items():
    register(_name, _fit)
register("lasso0", tagged.fit_lasso, clipped=False)


def available() -> list[str]:
    return list(ALGORITHMS)


def fit_named(name: str, ratings, *args, **kwargs):
    if name not in ALGORITHMS:
        raise KeyError(f"no algorithm named {name!r}; registered: {', '.join(ALGORITHMS)}")
    fit, defaults = ALGORITHMS[name]
    return fit(ratings, *args, **{**defaults, **kwargs})


def load_experiments(spark, path: str) -> list[tuple]:
    """(label, algorithm, parameters) from ``{"configurations": [[name, *values], ...]}``."""
    found = []
    for name, *values in json.loads(read_text(spark, path))["configurations"]:
        # Values follow the table arguments of the fit function, in order.
        names = [p for p in inspect.signature(ALGORITHMS[name][0]).parameters if p not in ("ratings", "item_tags", "n_tags")]
        label = "-".join([name, *[str(v).lower() for v in values]])
        found.append((label, name, dict(zip(names, values))))
    return found
