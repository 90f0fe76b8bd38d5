"""The tree of metrics: family, category, subcategory."""

from __future__ import annotations

from collections.abc import Iterable

from tabassay.errors import RegistryError

DIRECT = "_direct"
# The metrics and where they stand.
TREE: dict[str, dict[str, dict[str, tuple[str, ...]]]] = {
    "fidelity": {
        "global": {DIRECT: ("correlation_matrix", "mmd", "energy_distance", "outliers_coverage")},
        "marginal": {
            "tails": ("ks", "wasserstein", "anderson_darling", "hellinger", "kde_ise", "delta_exceedance"),
            "scales": ("delta_mean", "delta_median", "delta_iqr", "delta_mad", "cohens_d"),
            "coverage": ("tvd", "js", "kl", "psi", "entropy_delta", "gini_delta"),
        },
        "conditional": {"num_num": ("pearson", "spearman", "dcor", "mi"), "num_cat": ("eta_squared", "point_biserial", "kruskal_epsilon"), "cat_cat": ("cramers_v", "theils_u", "chi2_stat")},
    },
    "privacy": {
        "dataset_based": {"attribute_inference": ("mia", "inference_attack"), "reidentification": ("k_anonymity", "l_diversity", "t_closeness", "record_linkage"), "empirical_similarity": ("dcr", "nnaa")},
        "mechanism_based": {DIRECT: ("differential_privacy",)},
    },
    "utility": {"ml_efficiency": {"standalone": ("tts", "tstr", "trts", "ttrs"), "aggregate": ("ml_efficiency",)}},
}
#: Registered, but outside the tree.
OUTSIDE = ("utility.classification_efficiency", "utility.regression_efficiency")


def places() -> dict[str, tuple[str, str, str]]:
    return {f"{f}.{m}": (f, c, s) for f, cs in TREE.items() for c, ss in cs.items() for s, ms in ss.items() for m in ms}


PLACES = places()
ALL = (*PLACES, *OUTSIDE)


def expand(names: Iterable[str]) -> list[str]:
    """Ids and prefixes of the tree (``fidelity``, ``fidelity.marginal.tails``) to ids, each once, in order; a lone last part finds its metric."""
    out: dict[str, None] = {}
    for name in names:
        parts = name.split(".")
        if name in ALL:
            found = [name]
        else:
            found = [m for m, (f, c, s) in PLACES.items() if [f, c, s][: len(parts)] == parts] or [m for m in ALL if m.endswith(f".{name}")]
        if not found:
            raise RegistryError(f"no metric or group is called {name!r}")
        out.update(dict.fromkeys(found))
    return list(out)


def by_place(metrics: Iterable[str]) -> dict[str, dict[str, dict[str, list[str]]]]:
    out: dict = {}
    for m in metrics:
        f, c, s = PLACES.get(m, (m.split(".")[0], "other", DIRECT))
        out.setdefault(f, {}).setdefault(c, {}).setdefault(s, []).append(m)
    return out
