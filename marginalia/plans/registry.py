"""Rule registry, thresholds and layered configuration, as small dimension tables."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .extend import BlockRule, SubjectRule
from .vocabulary import COMMON_WORDS, EXCLUDED_PATHS, IGNORE_MARKER, LANGUAGES, RULES, THRESHOLDS

_RULE_KEYS, _TOP = {"enabled", "autofix", "tier"}, {"rules", "thresholds", "languages", "excluded_paths"}


@dataclass
class Config:
    """Settings of one run: rules and thresholds for all languages, and for single ones over them."""

    rules: dict[str, dict] = field(default_factory=dict)
    thresholds: dict[str, float] = field(default_factory=dict)
    languages: dict[str, dict] = field(default_factory=dict)
    excluded_paths: tuple[str, ...] = EXCLUDED_PATHS
    ignore_marker: str = IGNORE_MARKER
    common_words: tuple[str, ...] = COMMON_WORDS
    extra_rules: tuple[BlockRule | SubjectRule, ...] = ()

    @classmethod
    def parse(cls, text: str) -> Config:
        raw = tomllib.loads(text)
        out = cls(raw.get("rules", {}), raw.get("thresholds", {}), raw.get("languages", {}), tuple(raw.get("excluded_paths", EXCLUDED_PATHS)))
        if wrong := [f"unknown key {k}" for k in raw.keys() - _TOP] + out.problems():
            raise ValueError("; ".join(sorted(wrong)))
        return out

    @classmethod
    def load(cls, path: str | Path) -> Config:
        return cls.parse(Path(path).read_text())

    def problems(self) -> list[str]:
        """All that is wrong, not only the first."""
        known, wrong = {r[0] for r in all_rules(self)}, []
        wrong += [f"rule {r.name} is there already" for r in self.extra_rules if r.name in {x[0] for x in RULES}]
        for where, part in (("", {"rules": self.rules, "thresholds": self.thresholds}), *((f"languages.{k}.", v) for k, v in self.languages.items())):
            wrong += [f"unknown key {where}{k}" for k in part.keys() - {"rules", "thresholds"}]
            wrong += [f"unknown threshold {where}{k}" for k in part.get("thresholds", {}).keys() - THRESHOLDS.keys()]
            for rule, keys in part.get("rules", {}).items():
                wrong += [f"unknown rule {where}{rule}"] if rule not in known else []
                wrong += [f"unknown key {where}{rule}.{k}" for k in keys.keys() - _RULE_KEYS]
                wrong += [f"unknown tier {keys['tier']}"] if keys.get("tier", "gate") not in ("gate", "warn") else []
        return wrong + [f"unknown language {k}" for k in self.languages.keys() - LANGUAGES.keys()]

    def setting(self, lang: str, rule: str, key: str, default):
        own = self.languages.get(lang, {}).get("rules", {}).get(rule, {})
        return own.get(key, self.rules.get(rule, {}).get(key, default))

    def threshold(self, lang: str, name: str):
        return self.languages.get(lang, {}).get("thresholds", {}).get(name, self.thresholds.get(name, THRESHOLDS[name]))


def discover(start: str | Path, name: str) -> Path | None:
    """Nearest file of that name at or above a folder."""
    at = Path(start).absolute()
    return next((p / name for p in (at, *at.parents) if (p / name).is_file()), None)


REGISTRY = "lang string, rule string, kind string, tier string, fix string, autofix boolean, runs string, withheld_by string, enabled boolean"


def all_rules(config: Config) -> tuple[tuple, ...]:
    return RULES + tuple((r.name, r.line, r.block, r.doc, r.autofix, r.runs, r.withheld_by) for r in config.extra_rules)


def registry_rows(config: Config) -> list[tuple]:
    out = []
    for lang in LANGUAGES:
        for rule, line, block, doc, autofix, runs, withheld in all_rules(config):
            for kind, given in (("line", line), ("block", block), ("doc", doc)):
                if given:
                    tier, fix = given.split("/")
                    out.append((lang, rule, kind, config.setting(lang, rule, "tier", tier), fix, config.setting(lang, rule, "autofix", autofix), runs, withheld, config.setting(lang, rule, "enabled", True)))
    return out


def registry(spark: SparkSession, config: Config | None = None) -> DataFrame:
    """At most languages x rules x kinds rows, whatever the data."""
    return spark.createDataFrame(registry_rows(config or Config()), REGISTRY)


def thresholds(spark: SparkSession, config: Config | None = None) -> DataFrame:
    config = config or Config()
    rows = [(k, *(config.threshold(k, n) for n in ("absolute_doc_lines", "doc_lines_per_member")), float(config.threshold(k, "density_allowance"))) for k in LANGUAGES]
    return spark.createDataFrame(rows, "lang string, absolute_doc_lines long, doc_lines_per_member long, density_allowance double")


def languages(spark: SparkSession) -> DataFrame:
    rows = [(k, v["extensions"], v["interpreters"], v["directives"], v["generated"], v["references"]) for k, v in LANGUAGES.items()]
    return spark.createDataFrame(rows, "lang string, extensions array<string>, interpreters array<string>, directives array<string>, generated array<string>, refs array<string>")


def defaults_toml() -> str:
    """The defaults as a configuration file; reading it back changes nothing."""
    show = lambda x: f"{x:g}"
    out = ["[thresholds]", *(f"{k} = {show(v)}" for k, v in THRESHOLDS.items())]
    for rule, line, block, doc, autofix, *_ in RULES:
        out += ["", f"# line: {line or '-'}   block: {block or '-'}   doc: {doc or '-'}", f"[rules.{rule}]", "enabled = true", f"autofix = {str(autofix).lower()}"]
    return "\n".join(out) + "\n"
