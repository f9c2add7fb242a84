"""Plan building blocks: staged tables, ordinals and running sums that need no single task."""
