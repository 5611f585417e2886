"""Run configurations: loading, path resolution, cross-field rules, sizes."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from millrace.sources.readers import resolved


class ConfigError(ValueError):
    """A configuration breaks a rule."""


#: Fields that hold paths, and the values a field may take.
PATHS = ("dataset.algorithm_problem_dataset_path", "memory.storage_path", "training.resume_optimizer_path", "policy.adapter_path")
CHOICES = {
    "policy.backend": ("transformers", "vllm"), "decomposition.backend": ("policy", "dataset"), "repair.group_mode": (
        "immediate",
        "shared_feedback",
        "group_judge",
    ),
    "sandbox.backend": ("docker", "unshare", "local_limited", "subprocess"), "teacher.feedback_visibility": ("aggregate", "full"),
}
DEFAULTS = {
    "repair.group_mode": "immediate",
    "sandbox.backend": "docker",
    "teacher.feedback_visibility": "aggregate",
    "reward.answer_gate_floor": 1.0,
    "repair.repair_budget": 1,
}
UNITS = {"k": 1, "m": 2, "g": 3}


def get(config: dict, path: str, default: Any = None) -> Any:
    """Value at a dotted path, else the known default, else the given one."""
    value: Any = config
    for part in path.split("."):
        if not isinstance(value, dict) or part not in value:
            return DEFAULTS.get(path, default)
        value = value[part]
    return value


def load(path: str) -> dict:
    """A JSON configuration; relative paths are resolved from its folder."""
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    if not isinstance(config, dict):
        raise ConfigError("a configuration is an object")
    for field in PATHS:
        section, name = field.split(".")
        if value := get(config, field):
            config[section][name] = resolved(str(value), path)
    return config


def _number(config: dict, path: str) -> float:
    return float(get(config, path, 0) or 0)


Rule = tuple[str, Callable[[dict, str], bool]]
#: (what must hold, test of configuration and mode).
RULES: tuple[Rule, ...] = (
    ("a dataset path is given", lambda c, _: bool(get(c, PATHS[0]))),
    ("dataset.offset is not negative", lambda c, _: _number(c, "dataset.offset") >= 0),
    ("a policy model is named", lambda c, _: bool(get(c, "policy.model_name_or_path"))),
    ("training runs in the process of the model", lambda c, m: m != "train" or get(c, "policy.backend") == "transformers"),
    ("training has at least two rollouts a problem", lambda c, m: m != "train" or _number(c, "rollout.num_rollouts") >= 2),
    ("rollout.enable_thinking is a boolean", lambda c, _: isinstance(get(c, "rollout.enable_thinking", False), bool)),
    ("training.initial_update_count is not negative", lambda c, _: _number(c, "training.initial_update_count") >= 0),
    (
        "a resumed training has its count and its optimizer",
        lambda c, m: m != "train" or (_number(c, "training.initial_update_count") != 0) == bool(str(get(c, "training.resume_optimizer_path", "")).strip()),
    ),
    ("reward.answer_gate_floor lies within 0 and 1", lambda c, _: 0 <= float(get(c, "reward.answer_gate_floor")) <= 1),
    ("reward.span_answer_credit is not negative", lambda c, _: _number(c, "reward.span_answer_credit") >= 0),
    ("reward.lambda_teacher is not negative", lambda c, _: _number(c, "reward.lambda_teacher") >= 0),
    ("repair.repair_budget is not negative", lambda c, _: _number(c, "repair.repair_budget") >= 0),
    ("repair.max_teacher_calls_per_problem is not negative", lambda c, _: _number(c, "repair.max_teacher_calls_per_problem") >= 0),
    ("group modes beyond immediate are for training", lambda c, m: m == "train" or get(c, "repair.group_mode") == "immediate"),
    (
        "a judged group has one call, a teacher weight and aggregate feedback",
        lambda c, _: get(c, "repair.group_mode") != "group_judge" or (
            _number(
                c,
                "repair.max_teacher_calls_per_problem",
            ) == 1 and _number(c, "reward.lambda_teacher") > 0 and get(c, "teacher.feedback_visibility") == "aggregate"
        ),
    ),
    ("repair has a teacher", lambda c, _: not get(c, "repair.enabled", False) or bool(get(c, "teacher.enabled", False))),
    (
        "local execution is allowed explicitly",
        lambda c, _: get(c, "sandbox.backend") not in ("local_limited", "subprocess") or bool(get(c, "sandbox.allow_unsafe_subprocess", False)),
    ),
)


def broken_rules(config: dict, mode: str) -> list[str]:
    """All rules that a configuration breaks, choices first."""
    out = [f"{path} is one of {', '.join(values)}" for path, values in CHOICES.items() if get(config, path) not in values]
    return out + [text for text, holds in RULES if not holds(config, mode)]


def require_valid(config: dict, mode: str) -> None:
    if broken := broken_rules(config, mode):
        raise ConfigError("; ".join(broken))


def byte_size(value: str | int) -> int:
    """Positive number of bytes, with k, m or g (and b or ib after it) as binary multiples."""
    text = str(value).strip().lower()
    core = text.removesuffix("ib") if text.endswith("ib") else text.removesuffix("b")
    power = UNITS.get(core[-1:], 0)
    try:
        size = int(float(core[:-1]) * 1024**power) if power else int(text)
    except ValueError:
        raise ConfigError(f"no size: {value!r}") from None
    if size <= 0:
        raise ConfigError(f"no positive size: {value!r}")
    return size
