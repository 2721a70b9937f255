import sys

from kartei.cli import main

sys.exit(main())
