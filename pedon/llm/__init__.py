"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.
"""

import os

# models are small and tasks many: one thread for each numpy process, unless the user says otherwise
os.environ.setdefault("OMP_NUM_THREADS", "1")
