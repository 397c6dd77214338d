"""Tables that are written batch by batch: approved versions, and the bounded log."""
