import sys

from vectrail.runner import main

sys.exit(main())
