"""Run settings. Every value is a plain parameter; defaults are the usual weekly study."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class AssetQuery:
    """Channels to look in and words to look for, for one asset."""

    asset: str
    channels: tuple[str, ...]
    keywords: tuple[str, ...]
    ticker: str | None = None


@dataclass(frozen=True)
class PostSettings:
    max_posts_per_query: int = 600
    include_comments: bool = False
    max_comments_per_post: int = 30
    min_text_length: int = 15


@dataclass(frozen=True)
class LabelSettings:
    horizon_weeks: int = 1
    neutral_threshold: float = 0.002
    drop_neutral: bool = True


@dataclass(frozen=True)
class TextSettings:
    keyword_lexicon: tuple[str, ...] = ()
    sentiment_backend: str = "lexicon"
    model_batch_size: int = 16
    max_features: int = 8000
    min_df: int = 2
    ngram_range: tuple[int, int] = (1, 2)
    channels: tuple[str, ...] | None = None


@dataclass(frozen=True)
class ValidationSettings:
    train_min_weeks: int = 78
    val_weeks: int = 12
    step_weeks: int = 4
    test_weeks: int = 26


@dataclass(frozen=True)
class ModelSettings:
    """One classifier: whether it takes part, and its solver parameters."""

    name: str
    enabled: bool = True
    params: dict = field(default_factory=dict)


def default_models() -> tuple[ModelSettings, ...]:
    return (
        ModelSettings("naive_persistence"),
        ModelSettings("market_logreg", params={"C": 1.0, "max_iter": 2000}),
        ModelSettings("text_logreg", params={"C": 1.0, "max_iter": 2000}),
        ModelSettings("hybrid_logreg", params={"C": 0.8, "max_iter": 2500}),
        ModelSettings("linear_svm", params={"C": 1.0}),
        ModelSettings("random_forest", params={"n_trees": 300, "max_depth": 8, "min_leaf": 8}),
        ModelSettings(
            "boosted_trees",
            enabled=False,
            params={"n_rounds": 400, "max_depth": 4, "learning_rate": 0.05,
                    "row_share": 0.8, "column_share": 0.8},
        ),
    )


@dataclass(frozen=True)
class StudySettings:
    """Everything one study needs besides its tables."""

    week_anchor: str = "W-SUN"
    #: What to look for, in which span (end excluded for bars), and how posts were landed: "archive" or "search".
    assets: tuple[AssetQuery, ...] = ()
    start: str | None = None
    end: str | None = None
    source: str = "archive"
    posts: PostSettings = PostSettings()
    label: LabelSettings = LabelSettings()
    text: TextSettings = TextSettings()
    validation: ValidationSettings = ValidationSettings()
    models: tuple[ModelSettings, ...] = field(default_factory=default_models)


def study_settings(values: Mapping) -> StudySettings:
    """Settings from a nested mapping, such as a JSON file; what is missing keeps its default.

    ``models`` maps a name to its parameters and an optional ``enabled`` flag, ``assets`` an asset
    to its channels, keywords and ticker, both in order.
    """

    def part(kind, found: Mapping):
        known = {f.name for f in fields(kind)}
        unknown = set(found) - known
        if unknown:
            raise ValueError(f"unknown settings for {kind.__name__}: {sorted(unknown)}")
        return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.items()})

    parts = {"posts": PostSettings, "label": LabelSettings, "text": TextSettings, "validation": ValidationSettings}
    given = {name: part(kind, values[name]) for name, kind in parts.items() if name in values}
    given |= {name: values[name] for name in ("week_anchor", "start", "end", "source") if name in values}
    if given.get("source", "archive") not in ("archive", "search"):
        raise ValueError(f"source has to be archive or search, not {given['source']!r}")
    if "assets" in values:
        given["assets"] = tuple(part(AssetQuery, {"asset": name, **found}) for name, found in values["assets"].items())
    if "models" in values:
        given["models"] = tuple(
            ModelSettings(name, bool(p.get("enabled", False)), {k: v for k, v in p.items() if k != "enabled"})
            for name, p in values["models"].items()
        )
    return StudySettings(**given)
