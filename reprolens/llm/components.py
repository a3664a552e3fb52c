"""Connected components of links: over tables, and within one task."""

from reprolens.operators.components import connected as connected, roots as roots  # used by the operators from here
