import sys

from strandmill.cli import main

sys.exit(main())
