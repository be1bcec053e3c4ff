"""All registered queries. Importing this registers them."""

from lectern.plans import course, learning, material, more, quiz, search, study, texts  # noqa: F401
from lectern.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
