"""``tests.compare`` with nearly every key cut into slots."""

import runpy
import sys

from callscope.operators import slots

slots.HOT_ROWS = 5
sys.argv[0] = "tests.compare"
runpy.run_module("tests.compare", run_name="__main__")
