"""Source-comment analytics on PySpark: files to fact tables to findings, all of it as DataFrames."""

from .check import Report, check, check_paths, corrected
from .plans.extend import BlockRule, SubjectRule, register_language, unregister_language
from .plans.registry import Config, defaults_toml, languages, registry, thresholds

__version__ = "0.2.0"
__all__ = ["BlockRule", "Config", "Report", "SubjectRule", "check", "check_paths", "corrected", "defaults_toml", "languages", "register_language", "registry", "thresholds", "unregister_language"]
