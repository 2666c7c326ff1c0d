"""Where rows, changes and catalog relations come from."""
