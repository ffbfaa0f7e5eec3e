"""Request limits and prompt sizes."""

# Request limits of the repository path.
REQUESTS_PER_MINUTE = 12
MIN_GAP_SECONDS = 5
SECONDS_PER_FILE = 45
PROGRESS_CEILING = 85

# Daily request limits, best model first. Model names are the caller's.
MODEL_LIMITS = [200, 50, 1500, 4000]


def model_limits(names: list[str]) -> list[tuple[str, int, int]]:
    """(model, preference, daily limit) rows for the caller's model names, best first."""
    return [(name, i, limit) for i, (name, limit) in enumerate(zip(names, MODEL_LIMITS))]


# Length up to which a prompt stays whole, lines of a part beyond it, reply excerpts.
PROMPT_MAX_CHARS = 15000
PROMPT_PART_LINES = 200
RAW_EXCERPT = 500
MIN_CONTENT_CHARS = 10

HISTORY_KEPT = 20
