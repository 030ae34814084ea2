"""Import every query module so that the registry is complete."""
from . import t1_sources, t2_book_tape, t3_pairs, t4_info, t5_walk, t6_controls  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
