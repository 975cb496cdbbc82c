"""Settings, as one explicit value that operators take; nothing reads the environment on its own."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace

# The defaults that results depend on.
TICKET_PATTERN = r"\b([A-Z][A-Z0-9]{1,9}-\d{1,6})\b"
EMAIL_RULE = r"\b[\w.+-]+@[\w-]+\.[\w.]{2,}\b"
AUTOMATION_IDENTITIES = ("jenkins", "renovate", "snyk", "greenkeeper", "devops-team", "embedded_devops_sa")
COMMENT_NOISE = (
    r"(?i)\b(jenkins|build (succeeded|failed|#)|pipeline|bitbucket|pull request"
    r"|auto-?generated|sonarqube|renovate|stack ?trace|caused by:|at (uk|com|net|io|java|org)\.)"
)
STEP_LANGUAGES = {
    "java": ("src/test/java/**/*.java", r'@(?:Given|When|Then|And|But)\s*\(\s*"(.*?)"\s*\)', r"(?:public\s+)?class\s+(\w+)"),
    "python": ("**/*.py", r"@(?:given|when|then|step)\s*\(\s*[\"'](.*?)[\"']\s*[,)]", None),
    "typescript": ("**/*.ts", r"\b(?:Given|When|Then)\s*\(\s*[\"'](.*?)[\"']\s*,", None),
}
STOP_WORDS = (
    "a an and any are as at be but by can could do does did for from how i in is it its me my of on or our shall should show so tell that the "
    "their them there these this those to us we what when where which who whose why will with would you your exist exists existed thing things "
    "way ways going want wants"
)


@dataclass(frozen=True)
class Settings:
    """Every threshold and pattern, with its default."""

    ticket_pattern: str = TICKET_PATTERN
    sensitive_patterns: Mapping[str, str] = field(default_factory=lambda: {"email-address": EMAIL_RULE})
    automation_identities: tuple[str, ...] = AUTOMATION_IDENTITIES
    comment_noise: str = COMMENT_NOISE
    comment_chars: int = 2000
    tracker_projects: tuple[str, ...] = ()
    tracker_deny: tuple[str, ...] = ()
    page_size: int = 100
    ticket_browse_url: str = ""
    ticket_detail_chars: int = 300
    min_entry_degree: int = 3
    e2e_repos: tuple[str, ...] = ()
    min_community_size: int = 25
    dive_top_files: int = 15
    dive_min_cochange: int = 10
    cochange_max_files: int = 40
    deploy_max_keys: int = 60
    deploy_value_chars: int = 200
    deploy_page_keys: int = 12
    deploy_base_env: str = "_base"
    features_dir: str = "features/"

    def with_overrides(self, overrides: Mapping[str, object]) -> "Settings":
        """A copy with some settings replaced; an unknown name is an error."""
        unknown = sorted(set(overrides) - {f.name for f in fields(self)})
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        fixed = dict(overrides)
        if "ticket_browse_url" in fixed:
            fixed["ticket_browse_url"] = browse_url(str(fixed["ticket_browse_url"]))
        return replace(self, **fixed)

    def with_rules(self, rules_json: str) -> "Settings":
        """A copy whose redaction rules are the current ones overlaid by a JSON object; malformed JSON is an error."""
        rules = json.loads(rules_json)
        if not isinstance(rules, dict) or not all(isinstance(v, str) for v in rules.values()):
            raise ValueError("redaction rules must be a JSON object of strings")
        return replace(self, sensitive_patterns={**self.sensitive_patterns, **rules})


def from_environment(env: Mapping[str, str], prefix: str) -> Settings:
    """Settings from variables named ``prefix`` and a setting's name in capitals, by the setting's type.

    Lists are comma-separated; ``sensitive_patterns`` is a JSON object that overlays the rules. Unknown names and values that don't parse are errors.
    """
    named = {k.removeprefix(prefix).lower(): v for k, v in env.items() if k.startswith(prefix)}
    kinds = {f.name: getattr(DEFAULTS, f.name) for f in fields(Settings)}
    out: dict[str, object] = {}
    rules = named.pop("sensitive_patterns", None)
    for name, value in named.items():
        kind = kinds.get(name)
        try:
            out[name] = tuple(x.strip() for x in value.split(",") if x.strip()) if isinstance(kind, tuple) else int(value) if isinstance(kind, int) else value
        except ValueError as e:
            raise ValueError(f"{prefix}{name.upper()}: {value!r} is no number") from e
    made = DEFAULTS.with_overrides(out)
    return made if rules is None else made.with_rules(rules)


def browse_url(value: str) -> str:
    """A prefix that a ticket id can follow: a slash is added unless a separator already ends it."""
    value = value.strip()
    return value if not value or value.endswith(("/", "=", "?", "&", "#")) else value + "/"


DEFAULTS = Settings()
