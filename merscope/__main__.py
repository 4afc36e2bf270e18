import sys

from merscope.cli import main

sys.exit(main())
