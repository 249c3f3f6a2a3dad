"""``python -m lexpack``."""

import sys

from lexpack.cli import main

sys.exit(main())
