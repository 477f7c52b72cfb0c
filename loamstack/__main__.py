import sys

from loamstack.cli import main

sys.exit(main())
