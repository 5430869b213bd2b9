"""Arguments of the jobs from one configuration mapping.

Each part is the keyword arguments of its job: what the mapping does not say is
left out and stays at the job's own default.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pairforge import constants as K
from pairforge.functions.prompts import Prompts
from pairforge.operators.metrics import LossSettings
from pairforge.sources.catalogue import Source, catalogue_from_config


def _taken(config: Mapping, names: Mapping[str, tuple[str, ...]]) -> dict:
    """Arguments under our names; a path of keys leads to each value."""
    out = {}
    for ours, path in names.items():
        value = config
        for key in path:
            value = value.get(key) if isinstance(value, Mapping) else None
        if value is not None:
            out[ours] = value
    return out


@dataclass(frozen=True)
class JobSettings:
    """``build_corpus(spark, root, s.catalogue, out, **s.build)`` and so on."""

    catalogue: list[Source]
    languages: list[str]
    tasks: list[str]
    #: Tasks that are declared for later and not enabled.
    later_tasks: list[str]
    build: dict = field(default_factory=dict)
    embed: dict = field(default_factory=dict)
    align: dict = field(default_factory=dict)
    report: dict = field(default_factory=dict)
    evaluate: dict = field(default_factory=dict)

    @classmethod
    def from_config(cls, config: Mapping) -> "JobSettings":
        if not isinstance(config, Mapping):
            raise TypeError(f"a configuration is a mapping, not {type(config).__name__}")
        listed = lambda part, key, default: list((config.get(part) or {}).get(key, default))
        prompts = Prompts.from_config(dict(config))
        languages = listed("languages", "active", K.ACTIVE_LANGUAGES)
        return cls(
            catalogue=catalogue_from_config(dict(config)),
            languages=languages,
            tasks=listed("tasks", "active", K.ACTIVE_TASKS),
            later_tasks=listed("tasks", "later", ()),
            build=_taken(config, {"max_unique": ("caps", "max_unique_texts"), "per_shard": ("caps", "examples_per_shard")}),
            embed={"prompts": prompts, **_taken(config, {"batch_size": ("embed", "batch_size"), "max_length": ("max_length",)})},
            align={
                "prompts": prompts,
                "settings": LossSettings.from_config(dict(config)),
                **_taken(config, {"batch_size": ("train", "batch_size"), "max_texts": ("train", "target_embeddings_n"), "seed": ("train", "seed")}),
            },
            report=_taken(config, {"every": ("train", "log_every")}),
            evaluate={"prompts": prompts, "languages": languages, **_taken(config, {"limit": ("eval", "retrieval_proxy_size")})},
        )
