"""Named queries over the tables of a data folder, each with its SQL where SQL can say it."""
