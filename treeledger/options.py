"""Tunable defaults. Plain dataclasses: pass a changed copy to override one."""

from __future__ import annotations

from dataclasses import dataclass

KB = 1024
MB = 1024 * 1024

# Path globs and suffix lists every deployment starts from.
VENDOR_GLOBS = (
    "node_modules/**",
    "**/node_modules/**",
    "**/site-packages/**",
    "**/dist-info/**",
    "**/*.dist-info/**",
    "**/*.egg-info/**",
    "vendor/**",
    "**/__pycache__/**",
    ".venv/**",
    "venv/**",
)
IGNORE_GLOBS = (
    "**/*.pyc", "**/*.so", "**/*.map",
    "**/package-lock.json", "**/yarn.lock", "**/pnpm-lock.yaml",
    "**/poetry.lock", "**/Pipfile.lock", "**/composer.lock",
    "**/Cargo.lock", "**/go.sum",
)
PARTIAL_SUFFIXES = (".crdownload", ".part", ".download", ".tmp", ".partial", ".opdownload")
# Endings stripped from a file stem, most specific first. The last
# one (a short commit id that must hold a digit) is split into shape and digit
# test by ``functions.paths.clean_name`` because RE2 engines have no lookahead.
STRIP_PATTERNS = (
    r"\s*\(\d+\)$",
    r"[-_][0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"[-_]\d{4}-\d{2}-\d{2}([-_T]\d{2}[-_:]?\d{2}([-_:]?\d{2})?)?$",
    r"[-_]\d{8}([-_T]\d{4,6})?$",
    r"[-_][0-9a-fA-F]{16,64}$",
    r"[-_]\d{10,13}$",
    r"[-_](copy|final|backup|bak|old|new|latest)$",
    r"[-_](main|master|develop|trunk|HEAD)$",
    r"[-_]v?\d+\.\d+(\.\d+)?([-.][A-Za-z0-9.]+)?$",
)


# Limits of an interactive tool, for callers who want its outcomes.
# None anywhere means no limit, which is the default.
INTERACTIVE_SCAN_BYTES = 2048 * KB
INTERACTIVE_COMPARE_BYTES = 512 * KB
INTERACTIVE_MANIFEST_BYTES = 8 * MB
INTERACTIVE_SNIFF_BYTES = 8192
INTERACTIVE_SLUG_LENGTH = 120
INTERACTIVE_ENTRY_POINTS = 10
INTERACTIVE_EVIDENCE = 12


@dataclass(frozen=True)
class ArrivalOptions:
    """Which arriving files count, and when they have settled."""

    extensions: tuple[str, ...] = (".zip",)
    partial_suffixes: tuple[str, ...] = PARTIAL_SUFFIXES
    stable_seconds: float = 2.0
    give_up_seconds: float = 900.0
    recent_seconds: float = 300.0
    startup_hours: float = 24.0


@dataclass(frozen=True)
class ArchiveOptions:
    """Limits on one archive, and how many versions an artifact keeps (0 = all)."""

    max_bytes: int = 2048 * MB
    max_files: int = 200_000
    strip_wrapper: bool = True
    keep_versions: int = 0


@dataclass(frozen=True)
class ScanOptions:
    """What is read for text facts."""

    vendor_globs: tuple[str, ...] = VENDOR_GLOBS
    max_scan_bytes: int | None = None
    entry_points: int | None = None
    evidence: int | None = None


@dataclass(frozen=True)
class CompareOptions:
    """How two versions are compared."""

    hide_vendored: bool = True
    ignore_globs: tuple[str, ...] = IGNORE_GLOBS
    context_lines: int = 3
    max_compare_bytes: int | None = None
    max_diff_lines: int = 2000
    collapse_whitespace: bool = True
    long_line_mean: int = 400
    min_moved_files: int = 3
    rename_threshold: float = 0.55
    rename_settled: float = 0.8
    rename_key_bonus: float = 0.15
    min_size_ratio: float = 0.2
    max_size_ratio: float = 5.0


@dataclass(frozen=True)
class AnswerOptions:
    """Most entries of an answer's lists and most characters of its texts (None = all)."""

    changes: int | None = None
    risks: int | None = None
    steps: int | None = None
    headline_chars: int | None = None
    summary_chars: int | None = None
    prose_chars: int | None = None
    title_chars: int | None = None
    detail_chars: int | None = None
    step_chars: int | None = None
    reason_chars: int | None = None


@dataclass(frozen=True)
class ReviewOptions:
    """Budgets for the text handed to a reviewer."""

    budget: int = 150_000
    min_item_cap: int = 3000
    min_room: int = 400
    title_overhead: int = 40
    removed_lines: int = 40
    max_deps: int = 80
    max_findings: int = 30
    mount_file_bytes: int = 256 * KB
    mount_total_chars: int = 4_000_000
