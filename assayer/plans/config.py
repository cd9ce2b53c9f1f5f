"""Job descriptions from plain mappings, such as a parsed configuration file."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, fields
from typing import Any

from assayer.functions.reasoning import Delimiters
from assayer.operators.metrics import adapters
from assayer.plans.spec import (
    AnalysisSpec,
    EvaluationSpec,
    ModelSpec,
    RagSpec,
    SpecError,
    TaskSpec,
)

# Builds the plug-ins of a model from its settings.
ModelFactory = Callable[[Mapping[str, Any]], ModelSpec]
# Builds the loader of a text encoder from its settings.
EmbedderFactory = Callable[[Mapping[str, Any]], Any]


# Settings that have no meaning here: charts, progress logs, caches of a model hub.
_WITHOUT_EFFECT = {
    EvaluationSpec: {"log_progress", "progress_every_batches", "log_level"},
    AnalysisSpec: {"image_format", "plot_set"},
    TaskSpec: {"prediction_postprocess"},
}


@dataclass(frozen=True)
class Job:
    models: Sequence[ModelSpec]
    tasks: Sequence[TaskSpec]
    evaluation: EvaluationSpec
    analysis: AnalysisSpec


def read_job(
    config: Mapping[str, Any],
    model_types: Mapping[str, ModelFactory],
    embedder: EmbedderFactory | None = None,
) -> Job:
    """A job from ``models, tasks, evaluation, analysis``.

    ``model_types`` maps the ``type`` of a model to what builds it. ``embedder`` builds
    the encoder of tasks with an ``embedding_model``; a ``model_path`` of ``hashed`` needs
    none.
    """
    for section in ("models", "tasks"):
        if not isinstance(config.get(section), Sequence) or isinstance(config[section], str):
            raise SpecError(f"{section}: a list is needed")
    return Job(
        [_model(m, model_types) for m in config["models"]],
        [_task(t, embedder) for t in config["tasks"]],
        _build(EvaluationSpec, "evaluation", config.get("evaluation") or {}),
        _build(AnalysisSpec, "analysis", config.get("analysis") or {}),
    )


def _build(kind: type, owner: str, settings: Mapping[str, Any], **replaced: Any):
    """A description from its settings; an unknown or a missing one is an error."""
    if not isinstance(settings, Mapping):
        raise SpecError(f"{owner}: a mapping is needed")
    known = {f.name for f in fields(kind)}
    settings = {k: v for k, v in settings.items() if k not in _WITHOUT_EFFECT.get(kind, ())}
    unknown = sorted(set(settings) - known)
    if unknown:
        raise SpecError(f"{owner}: unknown settings {', '.join(unknown)}")
    try:
        return kind(**{**settings, **replaced})
    except TypeError as error:
        raise SpecError(f"{owner}: {error}") from None


def _model(settings: Mapping[str, Any], model_types: Mapping[str, ModelFactory]) -> ModelSpec:
    for name in ("name", "type"):
        if not settings.get(name):
            raise SpecError(f"models: '{name}' is needed")
    if settings["type"] not in model_types:
        raise SpecError(f"models: unknown type '{settings['type']}'; known: {', '.join(sorted(model_types))}")
    return model_types[settings["type"]](settings)


def _task(settings: Mapping[str, Any], embedder: EmbedderFactory | None) -> TaskSpec:
    owner = f"task '{settings.get('name', '?')}'"
    metrics = settings.get("metrics") or ()
    if isinstance(metrics, str) or not isinstance(metrics, Sequence):
        raise SpecError(f"{owner}: metrics must be a list")
    mappings = settings.get("input_mappings")
    if not isinstance(mappings, Mapping):
        raise SpecError(f"{owner}: input_mappings must be a mapping")
    marks = settings.get("thinking_delimiters")
    replaced: dict[str, Any] = {
        "metrics": [m if isinstance(m, str) else _metric(m, owner) for m in metrics],
        "thinking_delimiters": _build(Delimiters, f"{owner}: thinking_delimiters", marks) if marks else None,
        "strip_from_prediction": bool(settings.get("strip_from_prediction")),
        "rag": _rag(settings["rag"], owner, embedder) if settings.get("rag") is not None else None,
    }
    return _build(TaskSpec, owner, settings, **replaced)


def _metric(settings: Mapping[str, Any], owner: str) -> tuple:
    adapter = settings.get("adapter", "default")
    if adapter.lower() not in adapters():
        raise SpecError(f"{owner}: unknown metric adapter '{adapter}'; known: {', '.join(adapters())}")
    plain = (settings["name"], settings.get("args", {}))
    return plain if adapter in ("default", "hf") else (*plain, adapter)


def _rag(settings: Mapping[str, Any], owner: str, embedder: EmbedderFactory | None) -> RagSpec:
    own = {k: v for k, v in settings.items() if k != "embedding_model"}
    encoder = settings.get("embedding_model") or {}
    if encoder.get("model_path") == "hashed":
        own["embedder"] = "hashed"
    elif encoder.get("model_path"):
        if embedder is None:
            raise SpecError(f"{owner}: rag: an embedder plug-in is needed for {encoder['model_path']}")
        own["embedder"] = embedder(encoder)
    if "batch_size" in encoder:
        own["embed_batch_size"] = encoder["batch_size"]
    return _build(RagSpec, f"{owner}: rag", own)
