"""Session settings and the ordered-data building blocks every operator shares."""
