"""Checks of a configuration before anything is indexed with it."""

from __future__ import annotations

from collections.abc import Iterator

from tessera.operators.learning import Ranker

# The setting that leaves the choice to the profile, the known profiles, and the one that wants a GPU.
AUTO, PROFILES, WITH_GPU = "auto", ("cpu_small", "cpu_medium", "gpu_large"), "gpu_large"
MODELS = ("embedding_model", "cross_encoder_model")


def findings(config: dict, *, kept: int | None, version: int, ranker: Ranker, has_gpu: bool = False, profiles: tuple[str, ...] = PROFILES) -> Iterator[tuple[str, str, str]]:
    """(level, check, message). ``kept``: the version an index was kept with, None without one; ``version``: the current one."""
    for field in MODELS:
        value = config.get(field, AUTO)
        if value != AUTO and "/" not in value:
            yield "warning", field, f"{value!r} has no organisation before its name; {AUTO!r} takes the profile's model"
    profile = config.get("compute_profile", profiles[0])
    if profile not in profiles:
        yield "error", "compute_profile", f"{profile!r} is none of {', '.join(sorted(profiles))}"
    else:
        yield "ok", "compute_profile", profile
    if profile == WITH_GPU and not has_gpu:
        yield "warning", "gpu_profile", "this profile expects a GPU and there is none, so indexing will be slow"
    if kept is None:
        yield "error", "index_schema", "there is no index"
    elif kept != version:
        yield "warning", "index_schema", f"the index was kept by version {kept}, and {version} starts from nothing"
    else:
        yield "ok", "index_schema", f"version {kept}"
    yield "ok", "ranker", "trained" if ranker.is_trained else "not trained: fused ranks decide"
