"""All registered queries and the SQL that must give the same rows."""

from framequill.plans import certificates, contracts, kernels, media, pointers, requests, rulebook, sequences  # noqa: F401
from framequill.plans.catalog import QUERIES, SQL  # noqa: F401
