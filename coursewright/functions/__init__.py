"""Package of coursewright."""
