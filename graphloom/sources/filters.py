"""Which source files may be read: size, sensitive paths, secrets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BYTES = 10 * 1024 * 1024
# Paths that are never indexed.
SENSITIVE = (
    ".env", ".env.*", "**/.env.*", "*.env", "**/secrets/**", "**/credentials/**", "**/.aws/**", "**/.ssh/**", "**/private_key*", "**/*.key", "**/*.pem", "**/*.p12", "**/*.pfx",
    "**/config/database.yml", "**/config/secrets.yml", "**/.git/**", "**/.gitignore", "**/target/**", "**/node_modules/**", "**/.cargo/**", "**/fixtures/secrets/**",
    "**/*secret*", "**/*password*", "**/*credential*",
)
# Forms of credentials that are public knowledge.
SECRETS = (r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", r"\bAKIA[0-9A-Z]{16}\b", r"\bgh[pousr]_[A-Za-z0-9]{36}\b", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", r"(?i)\b(?:api[_-]?key|secret|password)\s*[:=]\s*[\"'][^\"'\s]{12,}[\"']")


def glob_regex(glob: str) -> str:
    """``**/`` stands for any folders or none, ``*`` and ``?`` also cross slashes."""
    out = ""
    for part in re.split(r"(\*\*/|/\*\*$|\*|\?)", glob):
        out += {"**/": "(?:.*/)?", "/**": "/.*", "*": ".*", "?": "."}.get(part, re.escape(part))
    return f"(?s)^{out}$"


def is_sensitive(path: Column, globs: tuple[str, ...] = SENSITIVE) -> Column:
    return path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs))


def has_secret(content: Column) -> Column:
    return content.rlike("|".join(f"(?:{s})" for s in SECRETS))


def readable(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files (path, content, size) without the large, sensitive and secret ones."""
    return files.where((F.col("size") <= max_bytes) & ~is_sensitive(F.col("path")) & ~has_secret(F.col("content")))
