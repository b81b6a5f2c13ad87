"""DataFrame operators. Column names are parameters, so they fit mines and other tables alike."""
