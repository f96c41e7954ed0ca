import sys

from driftmark.cli import main

sys.exit(main())
