import sys

from sluice.cli import main

sys.exit(main())
