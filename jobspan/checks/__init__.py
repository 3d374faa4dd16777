"""Every registered query; importing the modules fills the registry."""
from jobspan.checks import admission, boards, enrich, insights, search, text  # noqa: F401
from jobspan.checks.registry import ORACLES, QUERIES  # noqa: F401
