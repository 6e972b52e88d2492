"""DataFrame building blocks shared by the jobs in :mod:`fieldtally.plans`."""
