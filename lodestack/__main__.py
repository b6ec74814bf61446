import sys

from lodestack.cli import main

sys.exit(main())
