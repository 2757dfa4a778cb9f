"""Named queries (one per operator) and their DuckDB oracle SQL."""

from sway.plans.registry import ORACLES, QUERIES  # noqa: F401
from sway.plans import q_metrics  # noqa: F401  (registers queries)
from sway.plans import q_format, q_rounds  # noqa: F401,E402
from sway.plans import q_pack, q_text, q_vectors  # noqa: F401,E402
from sway.plans import q_paths  # noqa: F401,E402
from sway.plans import q_joins  # noqa: F401,E402
from sway.plans import q_files  # noqa: F401,E402
