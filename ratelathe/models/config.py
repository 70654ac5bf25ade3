"""Model profiles, strictly validated, and what each model needs to be fitted."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Annotated, Any, Literal

from pydantic import BaseModel, ConfigDict, Field, create_model, field_validator

#: The models from plain to rich, with the parts that each one has.
PARTS = {
    "biased_mf": "p q",
    "svdpp": "p q y",
    "asymmetric_svd": "q x y",
    "asvdpp": "p q x y",
    "cb_svdpp": "p q y pC qC yC",
    "cb_asvdpp": "p q x y pC qC xC yC",
}
FAMILY = "matrix_factorization"
Positive, NotNegative, Count = Annotated[float, Field(gt=0)], Annotated[float, Field(ge=0)], Annotated[int, Field(gt=0)]


class Strict(BaseModel):
    model_config = ConfigDict(extra="forbid")


class Metadata(Strict):
    status: str
    owner: str
    purpose: str
    provenance: dict[str, Any] | None = None


class Identity(Strict):
    name: str
    family: str
    # Fixed values, as are those of the other fields of a profile: its files must load.
    scope: Literal["paper_faithful", "paper_inspired", "extended"]


class Clustering(Strict):
    n_user_clusters: Count
    n_item_clusters: Count
    alpha: Annotated[float, Field(ge=0, le=1)]
    algorithm: Literal["kmeans"]
    kmeans_n_init: Count


def _training(name: str) -> type[BaseModel]:
    parts = PARTS[name].split()
    fields: dict[str, Any] = {"latent_dim": (Count, ...), "epochs": (Count, ...), "learning_rate": (Positive, ...), "lambda_b": (NotNegative, ...), "init_std": (Positive, ...), "dtype": (Literal["float32", "float64"], ...)}
    fields |= {f"lambda_{p}": (NotNegative, ...) for p in parts}
    if "y" in parts:
        fields["implicit_policy"] = (Literal["ratings_as_implicit"], ...)
    if "x" in parts:
        fields["residual_weight_contract"] = (Literal["detached"], ...)
    if name in ("biased_mf", "svdpp"):
        # exact and distributed are this engine's own; python and numba name the exact one.
        fields["training_backend"] = (Literal["auto", "exact", "distributed", "python", "numba"], ...)
    return create_model(f"{name}_training", __base__=Strict, **fields)


def _profile(name: str) -> type[BaseModel]:
    def named(cls: type, v: Identity) -> Identity:
        if v.name != name:
            raise ValueError(f"model.name must be {name}, not {v.name}")
        return v

    fields: dict[str, Any] = {"metadata": (Metadata, ...), "model": (Identity, ...), "notes": (list[str], ...), "training": (_training(name), ...)}
    if "pC" in PARTS[name]:
        fields["clustering"] = (Clustering, ...)
    return create_model(f"{name}_profile", __base__=Strict, __validators__={"named": field_validator("model")(named)}, **fields)


PROFILES = {name: _profile(name) for name in PARTS}


@dataclass(frozen=True)
class Requirements:
    """Which derived tables a model is fitted with."""

    history: bool
    explicit: bool
    clusters: bool

    def names(self) -> list[str]:
        wanted = {"user_history_index": self.history, "explicit_feedback_index": self.explicit, "cluster_artifacts": self.clusters, "user_cluster_history_index": self.clusters}
        return [k for k, v in wanted.items() if v]


def requirements(name: str) -> Requirements:
    parts = PARTS[check_name(name)].split()
    return Requirements("y" in parts, "x" in parts, "pC" in parts)


def requirements_payload(name: str) -> dict[str, Any]:
    r = requirements(name)
    return {"needs_implicit_history": r.history, "needs_explicit_feedback": r.explicit, "needs_cluster_artifacts": r.clusters, "needs_user_cluster_history": r.clusters, "supports_precomputed_indices": True, "supports_context_cache": True, "required_artifacts": r.names()}


def check_name(name: str) -> str:
    if name not in PARTS:
        raise ValueError(f"unknown model: {name}; known are {', '.join(PARTS)}")
    return name


def load_profile(payload: dict[str, Any], family: str | None = None) -> BaseModel:
    """A validated profile; ValueError for an unknown key, model or family, a missing field or a value out of range."""
    profile = PROFILES[check_name(payload.get("model", {}).get("name", ""))].model_validate(payload)
    if family and profile.model.family != family:
        raise ValueError(f"model.family must be {family}")
    return profile


def with_overrides(profile: BaseModel, overrides: dict[str, Any]) -> BaseModel:
    """The profile with training values replaced, validated again."""
    payload = profile.model_dump()
    return load_profile(payload | {"training": payload["training"] | overrides})


@dataclass(frozen=True)
class Config:
    """All a fit needs to know; ``penalties`` has a value for b and for each part of the model."""

    model: str
    latent_dim: int = 16
    epochs: int = 20
    learning_rate: float = 0.01
    penalties: tuple[tuple[str, float], ...] = ()
    init_std: float = 0.1
    dtype: str = "float32"
    seed: int = 42
    alpha: float = 0.0
    backend: str = "auto"

    def __post_init__(self) -> None:
        check_name(self.model)
        if self.latent_dim <= 0 or self.epochs <= 0 or self.learning_rate <= 0 or self.init_std <= 0:
            raise ValueError("latent_dim, epochs, learning_rate and init_std must be above 0")
        if self.dtype not in ("float32", "float64"):
            raise ValueError(f"dtype must be float32 or float64, not {self.dtype}")
        if not 0 <= self.alpha <= 1 or any(v < 0 for _, v in self.penalties):
            raise ValueError("alpha must be in [0, 1] and penalties not below 0")
        if self.backend not in ("auto", "exact", "distributed"):
            raise ValueError(f"unknown backend: {self.backend}")

    @property
    def parts(self) -> list[str]:
        return PARTS[self.model].split()

    def penalty(self, part: str) -> float:
        return dict(self.penalties).get(part, 0.02)


def config_of(profile: BaseModel, seed: int) -> Config:
    """The fit's configuration from a profile. Of the training backends, python and numba mean the exact one here."""
    t = profile.training
    backend = {"python": "exact", "numba": "exact"}.get(getattr(t, "training_backend", "auto"), getattr(t, "training_backend", "auto"))
    penalties = tuple((k[7:], v) for k, v in t.model_dump().items() if k.startswith("lambda_"))
    alpha = profile.clustering.alpha if hasattr(profile, "clustering") else 0.0
    return Config(profile.model.name, t.latent_dim, t.epochs, t.learning_rate, penalties, t.init_std, t.dtype, seed, alpha, backend)


def induction_config(config: Config) -> Config:
    """The factorization whose factors are clustered, with the dimensions and rates of a clustering-based model."""
    kept = tuple((k, v) for k, v in config.penalties if k in ("b", "p", "q"))
    return Config("biased_mf", config.latent_dim, config.epochs, config.learning_rate, kept, config.init_std, config.dtype, config.seed, 0.0, config.backend)


def cluster_semantics(alpha: float) -> dict[str, Any]:
    """What may be claimed about the clusters' effect: never by configuration alone; unmeasured unless alpha is 0."""
    reason = "no run with alpha 0 on the same split was compared" if alpha > 0 else "alpha is 0: clusters do not enter predictions"
    return {"alpha": alpha, "cluster_contribution_config_enabled": alpha > 0, "cluster_contribution_measured": None if alpha > 0 else False, "cb_claim_eligible": False, "cb_contribution_measured": None if alpha > 0 else False, "claim_gate_reason": reason}
