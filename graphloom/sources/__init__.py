"""Where tables come from and go to: source trees, lockfiles, change streams, snapshots."""
